"""Toxicity by a factorization machine over hashed terms.

Beside a weight, every term has a short vector; two terms of one text add
the product of their vectors, so pairs that are toxic together only (an
insult with the mention of a group) are learned as pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, materialize, with_row_key, without_rows

WORD = re.compile(r"[^\W_]+")
#: Terms are hashed to so many bits; at most this many labelled rows are learned from, drawn by md5 of the id.
HASH_BITS, TRAIN_ROWS = 26, 8_000
#: Terms in fewer documents of the sample are left out.
LEAST_DOCUMENTS = 8
FACTORS, RATE, DECAY, SEED = 6, 0.15, 1e-4, 7
#: Epochs and rows of a batch of the first pass, over all terms, and of the second, over those that it found to tell.
FIRST, SECOND = (15, 256), (25, 128)
#: The first pass draws weights, and whole vectors, to zero by these; terms go on to the second with a weight or a vector's length of these.
DRAW_WEIGHTS, DRAW_VECTORS, LEAST_WEIGHT, LEAST_LENGTH = 0.006, 0.001, 0.3, 0.5
#: Scores from here on are toxic.
THRESHOLD = 0.7
#: A worker remembers the hashes of so many words.
CACHE_SIZE = 100_000


class TermHasher:
    """The distinct hashed terms of a text: its words, and their first four and five characters."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            terms = [word] + [f"{n}:{word[:n]}" for n in (4, 5) if len(word) >= n]
            found = tuple(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1) for t in terms)
            if len(self.cache) >= CACHE_SIZE:
                self.cache.clear()
            self.cache[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        terms: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            terms.update(self.of_word(word))
        return np.fromiter(sorted(terms), np.int32, len(terms))


@dataclass
class FactorizationMachine:
    """terms: sorted hashes; weights and vectors by their order."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.terms, found)
        at = at[at < len(self.terms)] if len(self.terms) else at[:0]
        known = at[self.terms[at] == found[: len(at)]]
        z = self.bias + self.weights[known].sum()
        v = self.vectors[known]
        z += 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def gradients(bias: float, w: np.ndarray, v: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean logistic loss over rows of term numbers: the bias's, the terms they hold, and those terms' weights' and vectors'."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids = np.concatenate(rows)
    own = v[ids]
    sums = np.stack([np.bincount(doc, own[:, f], len(rows)) for f in range(v.shape[1])], axis=1).astype(v.dtype)
    z = bias + np.bincount(doc, w[ids], len(rows)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(doc, (own**2).sum(axis=1), len(rows)))
    slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
    held = np.flatnonzero(np.bincount(ids, minlength=len(w)))
    by_entry = slope[doc].astype(v.dtype)
    pulls = by_entry[:, None] * (sums[doc] - own)
    of_vectors = np.stack([np.bincount(ids, pulls[:, f], len(w))[held] for f in range(v.shape[1])], axis=1)
    return float(slope.sum()), held, np.bincount(ids, by_entry, len(w))[held], of_vectors


def descend(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, epochs: int, batch: int, draw_weights: float = 0.0, draw_vectors: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by adaptive steps in a fixed order; after a step, weights and vectors are drawn to zero by an amount."""
    rng = np.random.default_rng(SEED)
    base = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(base / (1 - base)))
    w, v = np.zeros(n_terms, np.float32), rng.normal(0, 0.02, (n_terms, FACTORS)).astype(np.float32)
    seen_w, seen_v, seen = np.full(n_terms, 1e-2, np.float32), np.full((n_terms, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            of_bias, held, of_weights, of_vectors = gradients(bias, w, v, [rows[i] for i in chosen], labels[chosen])
            of_weights, of_vectors = of_weights + DECAY * w[held], of_vectors + DECAY * v[held]
            seen_w[held] += of_weights**2
            seen_v[held] += of_vectors**2
            seen += of_bias**2
            bias -= RATE * of_bias / np.sqrt(seen)
            step = RATE / np.sqrt(seen_w[held])
            weights = w[held] - step * of_weights
            w[held] = np.sign(weights) * np.maximum(np.abs(weights) - step * draw_weights, 0)
            step = RATE / np.sqrt(seen_v[held])
            vectors = v[held] - step * of_vectors
            if draw_vectors:
                length = np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-12)
                vectors *= np.maximum(0, 1 - step.mean(axis=1, keepdims=True) * draw_vectors / length)
            v[held] = vectors
    return float(bias), w, v


def numbered(rows: list[np.ndarray], terms: np.ndarray) -> list[np.ndarray]:
    """The places of each row's hashes among the sorted terms; others are left out."""
    found = []
    for r in rows:
        at = np.minimum(np.searchsorted(terms, r), len(terms) - 1)
        found.append(at[terms[at] == r].astype(np.int32))
    return found


def train(rows: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
    """A machine learned twice: over all frequent terms, to see which tell alone or in pairs, then over those.

    In the first pass all terms learn weights and vectors together, so a
    term that tells nothing alone is found by what it does beside others;
    drawn to zero, terms without use stay small. They are left out of the
    second, as thousands of them would only add noise to long texts. Without
    rows of both labels the machine is a constant at the base rate.
    """
    base = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.0
    nothing = FactorizationMachine(float(np.log(base / (1 - base))) if base else -30.0, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    if not len(labels) or labels.min() == labels.max():
        return nothing
    terms, n = np.unique(np.concatenate(rows), return_counts=True)
    terms = terms[n >= LEAST_DOCUMENTS]
    if len(terms):
        _, w, v = descend(numbered(rows, terms), labels, len(terms), *FIRST, DRAW_WEIGHTS, DRAW_VECTORS)
        terms = terms[(np.abs(w) >= LEAST_WEIGHT) | (np.sqrt((v**2).sum(axis=1)) >= LEAST_LENGTH)]
    if not len(terms):
        return nothing
    bias, w, v = descend(numbered(rows, terms), labels, len(terms), *SECOND)
    return FactorizationMachine(bias, terms, w.astype(float), v.astype(float))


def sample_of_labels(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed terms and labels of at most `rows` labelled documents outside the held-out fold.

    Documents with several labels count as toxic if any label says so; of
    rows that repeat an id one is taken, the same on every run.
    """
    drawn = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = drawn.filter(~in_fold(F.col("doc_id"), 3, 1)).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = TermHasher()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [hasher(t).tobytes() for t in batch["text"]]})

    found = chosen.mapInPandas(hashed, "doc_id long, toxic int, terms binary").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("terms").alias("terms")).orderBy("doc_id").collect()
    return [np.frombuffer(r["terms"], np.int32) for r in found], np.array([float(r["toxic"] > 0) for r in found])


def fit(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    return train(*sample_of_labels(docs, labels))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    Whole texts are scored; null counts as empty, which scores the bias. A
    null id is not held out. Repeated rows are scored each; other columns
    are not looked at; an empty table gives an empty result.
    """
    # plain values: a worker may not have this module to load a class from
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.terms, model.weights, model.vectors))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, machine = TermHasher(), FactorizationMachine(*shared.value)
        for batch in batches:
            texts = batch.pop("text")
            yield batch.assign(score=[machine.score(hasher(t)) for t in texts])

    texts = docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less the rows predicted toxic by a model learned from the labels."""
    keyed = with_row_key(docs)
    scored = score_toxicity(keyed.withColumn("doc_id", F.col("__row")), fit(docs, labels))
    return without_rows(keyed, materialize(scored.filter("predicted = 1").select("doc_id"), "toxic"))
