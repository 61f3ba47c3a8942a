"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of the tokens that a fixed mask selects from a span; the
masks differ in which positions they ignore, so a substituted token breaks
some seeds and leaves others. Seeds of the benchmark join seeds of the
corpus; around each hit the two texts are laid side by side and compared
token by token, which tolerates substitutions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, with_row_key, without_rows

#: 1: the token counts, 0: it is ignored. Five tokens each.
MASKS = ("11111", "1101011", "101100101")
#: Masks of items too short for those, by their most tokens: cut in one piece more than tokens may differ, one piece is whole.
SHORT_MASKS = {5: "11", 10: "111"}
#: Aligned tokens that are compared at least (or the whole item, if shorter), and the share of them that must be equal.
WINDOW, SIMILARITY = 20, 0.8
#: Items of fewer tokens are too short to be evidence: any text may hold them by chance.
LEAST_TOKENS = 5
#: Items are broadcast only if all of them have no more tokens than this.
BROADCAST_TOKENS = 2_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(df: DataFrame, masks: Sequence[str]) -> DataFrame:
    """Rows of df (with `words` and `n`) once per position and mask: adds at, seed.

    Word hashes are taken once per word; positions and masks unroll inside
    one generated loop over the row's arrays, so no array is copied.
    """
    at = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    at = at.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    found = []
    for mask in masks:
        chosen = [F.get("hashes", F.col("at") + i) for i, bit in enumerate(mask) if bit == "1"]
        found.append(F.when(F.col("at") + len(mask) <= F.col("n"), F.xxhash64(F.lit(mask), *chosen)))
    return at.withColumn("seed", F.explode(F.array(*found))).drop("hashes").filter("seed is not null")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, matched, compared, similarity.

    A document overlaps an item if, somewhere, min(window, item's tokens)
    tokens laid side by side are equal at a share of `similarity` or more;
    matched and compared are those of the best such place. Overlaps are
    looked for around seed hits: five tokens in one of the masks' patterns,
    or for items of up to ten tokens a run of two or three; at the default
    similarity an overlap always has one. Tokens are letters and digits,
    lower-cased. Null and empty texts, and items of fewer than
    LEAST_TOKENS tokens, overlap nothing. Rows that repeat a doc_id or
    item_id count as one. Empty in, empty out; extra columns are not
    looked at.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter(F.col("n") >= LEAST_TOKENS).filter("item_id is not null").distinct()
    items = materialize(items, "items")
    by_mask, below = [], LEAST_TOKENS
    for most, mask in [*SHORT_MASKS.items(), (None, None)]:
        of_length = items.filter(F.col("n") >= below) if most is None else items.filter(F.col("n").between(below, most))
        if not of_length.isEmpty():
            by_mask.append((of_length, tuple(masks) if mask is None else (mask,)))
        below = below if most is None else most + 1
    used = tuple(m for _, some in by_mask for m in some) or tuple(masks)
    probes = [seeds(some, own).select("seed", "item_id", F.col("at").alias("item_at"), F.col("n").alias("item_n")) for some, own in by_mask or [(items, masks)]]
    for more in probes[1:]:
        probes[0] = probes[0].unionByName(more)
    probes = materialize(probes[0], "seeds")
    texts = with_row_key(docs, ["doc_id", "text"]).select("__row", "doc_id", tokens(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter(F.col("n") >= min(map(len, used)))
    if probes.count() <= BROADCAST_ROWS:
        hits = seeds(texts, used).join(F.broadcast(probes), "seed")
    else:  # both sides are shuffled, so the words are left behind and brought to the hits
        narrow = seeds(texts, used).select("seed", F.col("__row").alias("__hit"), "at").join(probes, "seed").drop("seed").distinct()
        hits = narrow.join(texts, F.col("__hit") == F.col("__row"))
    # the document's tokens beside the item's: from `start` (may be negative) on, item_n of them
    start = F.col("at") - F.col("item_at")
    lead = F.greatest(-start, F.lit(0))
    beside = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("item_n") - lead)
    hits = hits.select("doc_id", "item_id", start.alias("start"), lead.alias("lead"), beside.alias("beside")).distinct()
    there = items.select(F.col("item_id").alias("__item"), F.col("words").alias("item_words"), F.col("n").alias("item_n"))
    few = (items.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_TOKENS
    placed = hits.join(F.broadcast(there) if few else there, hits["item_id"] == there["__item"]).drop("__item")
    equal = F.transform("item_words", lambda w, i: (F.coalesce(F.get("beside", i - F.col("lead")), F.lit("")) == w).cast("int"))
    compared = F.least(F.lit(window), F.col("item_n"))
    placed = placed.select("doc_id", "item_id", equal.alias("equal"), compared.alias("compared"), "item_n")
    runs = F.transform(F.sequence(F.lit(1), F.col("item_n") - F.col("compared") + 1), lambda p: F.aggregate(F.slice("equal", p, F.col("compared")), F.lit(0), lambda a, b: a + b))
    found = placed.select("doc_id", "item_id", F.array_max(runs).alias("matched"), "compared").groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))
    return found.withColumn("similarity", F.col("matched") / F.col("compared")).filter(F.col("similarity") >= similarity)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs less the rows that overlap a benchmark item."""
    keyed = with_row_key(docs)
    found = find_overlaps(keyed.withColumn("doc_id", F.col("__row")), benchmark)
    return without_rows(keyed, materialize(found.select("doc_id").distinct(), "contaminated"))
