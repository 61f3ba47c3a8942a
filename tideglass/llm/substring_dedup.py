"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the word k-mers in each window of 13 words
the one with the least hash. Documents meet on anchors they share; around
every shared anchor the match is extended both ways, to all 13-word windows
that the anchor leads, and windows that a smaller doc_id holds too make up
the maximal repeats, which are removed.

As a window and its copies have the same anchor at the same place, no
repeat is missed, and windows led by an anchor of one document only need no
further look. Rows are dealt in blocks of a few MB, whatever their ids; a block tells each
anchor and window once, with its smallest doc_id, so a passage that a third
of the corpus holds is one entry per block. What a block tells goes to the
parts of the key space that it touches: never more rows than keys.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_row_key
from .words import mixed, word_hashes

#: Words of a window (the least repeat that is removed), and of an anchor's k-mer.
WINDOW, KMER = 13, 6
#: Bytes of text in a block, on average.
BLOCK_BYTES = 3_000_000
NO_ID = -(2**63)


def gram_hashes(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, seed, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + count]
    return mixed(out)


class Block:
    """The texts of a block: doc numbers each of its windows' document, at the window's first word."""

    def __init__(self, texts: Iterable[str | None], window: int = WINDOW, kmer: int = KMER):
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        starts, self.hashes = word_hashes(b" ".join(self.texts))
        self.window, self.kmer = window, kmer
        offsets = np.cumsum([0] + [len(t) + 1 for t in self.texts])
        doc = np.searchsorted(offsets, starts, side="right") - 1
        self.first_word = np.searchsorted(doc, np.arange(len(self.texts) + 1))
        n = max(0, len(doc) - window + 1)
        self.whole = doc[:n] == doc[window - 1 :]
        self.doc = doc[:n]

    @property
    def windows(self) -> np.ndarray:
        return gram_hashes(self.hashes, self.window, 1)

    @property
    def leads(self) -> np.ndarray:
        """For each window its anchor: the least of its k-mers' hashes."""
        grams = gram_hashes(self.hashes, self.kmer, 2)
        least = grams[: len(self.doc)].copy()
        for j in range(1, self.window - self.kmer + 1):
            np.minimum(least, grams[j : j + len(least)], out=least)
        return least


def least_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and the least and the largest value of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(starts):
        return keys, values, values
    return keys[starts], np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)


def packed(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers of one length as bytes: the sorted keys as differences, each next array less the one before."""
    rows = [np.diff(keys, prepend=np.uint64(0)), *values[:1], *(b - a for a, b in zip(values, values[1:], strict=False))]
    return zlib.compress(b"".join(r.tobytes() for r in rows), 1)


def unpacked(blob: bytes, n_arrays: int) -> list[np.ndarray]:
    data = np.frombuffer(zlib.decompress(blob), np.uint64).reshape(n_arrays, -1)
    values = np.cumsum(data[1:].view(np.int64), axis=0)
    return [np.cumsum(data[0], dtype=np.uint64), *values]


def dealt(block: int, parts: int, keys: np.ndarray, *values: np.ndarray) -> Iterable[tuple[int, int, bytes]]:
    """(part, block, blob) for each part of the key space that the sorted keys touch."""
    touched, starts = np.unique((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), return_index=True)
    for p, a, b in zip(touched.tolist(), starts, [*starts[1:], len(keys)], strict=True):
        yield p, block, packed(keys[a:b], *(v[a:b] for v in values))


DEALT = "part int, block int, blob binary"


def frame(rows: Iterable[tuple]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["part", "block", "blob"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER, blocks: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Words are runs of anything but space and controls 9 to 13, unchanged. A
    word goes if a window of 13 words covers it whose word sequence starts
    in a document of a smaller doc_id too, judged on the input; what is
    left is joined by single spaces. Repeats within one document, and
    between rows that share a doc_id, stay. Null text is no words; a null id
    is less than any other. Empty in, empty out; other columns are not
    looked at.
    """
    if not 0 < kmer <= window:
        raise ValueError("an anchor must fit in a window")
    keyed = with_row_key(docs, [id_col, text_col])
    n_blocks = blocks or max(1, -(-(keyed.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // BLOCK_BYTES))
    parts = n_blocks
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    source = keyed.select(F.pmod(F.xxhash64("__row"), F.lit(n_blocks)).cast("int").alias("block"), F.col(id_col).cast("long").alias("doc_id"), ids.alias("id"), F.col(text_col).alias("text"))
    by_block = source.groupBy("block")

    def told(pdf: pd.DataFrame, keys: np.ndarray, doc: np.ndarray) -> pd.DataFrame:
        ids = pdf["id"].to_numpy(np.int64)
        return frame(dealt(int(pdf["block"].iloc[0]), parts, *least_by(keys, ids[doc])))

    def anchors_of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf["text"], window, kmer)
        leads, doc = block.leads[block.whole], block.doc[block.whole]
        new = np.r_[True, (leads[1:] != leads[:-1]) | (doc[1:] != doc[:-1])][: len(leads)]
        return told(pdf, leads[new], doc[new])

    def shared_keys(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block, its keys of this part that several documents hold, with the smallest doc_id."""
        told_by = [unpacked(b, 3) for b in pdf["blob"]]
        keys = np.concatenate([t[0] for t in told_by])
        picked, least, _ = least_by(keys, np.concatenate([t[1] for t in told_by]))
        most = least_by(keys, np.concatenate([t[2] for t in told_by]))[2]
        picked, least = picked[least != most], least[least != most]
        rows = []
        for block, (own, *_) in zip(pdf["block"], told_by, strict=True):
            at = np.minimum(np.searchsorted(picked, own), max(0, len(picked) - 1))
            here = at[picked[at] == own] if len(picked) else at[:0]
            if len(here):
                rows.append((int(pdf["part"].iloc[0]), int(block), packed(picked[here], least[here])))
        return frame(rows)

    def windows_of_block(pdf: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or shared.empty:
            return frame([])
        anchors = np.sort(np.concatenate([unpacked(b, 2)[0] for b in shared["blob"]]))
        block = Block(pdf["text"], window, kmer)
        leads = block.leads
        led = block.whole & (anchors[np.minimum(np.searchsorted(anchors, leads), len(anchors) - 1)] == leads)
        return told(pdf, block.windows[led], block.doc[led])

    def kept_of_block(pdf: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        told_by = [unpacked(b, 2) for b in repeats["blob"]]
        keys = np.concatenate([t[0] for t in told_by] or [np.zeros(0, np.uint64)])
        least = np.concatenate([t[1] for t in told_by] or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys, least, ids = keys[order], least[order], pdf["id"].to_numpy(np.int64)
        block = Block(pdf["text"], window, kmer)
        covered = np.zeros(len(block.hashes) + 1, np.int32)
        if len(keys):
            windows = block.windows
            at = np.minimum(np.searchsorted(keys, windows), len(keys) - 1)
            starts = np.flatnonzero(block.whole & (keys[at] == windows) & (least[at] < ids[block.doc]))
            covered[starts] += 1
            covered[starts + window] -= 1
        gone = np.cumsum(covered) > 0
        rows = []
        for number, (doc_id, text) in enumerate(zip(pdf["doc_id"], block.texts, strict=True)):
            words, here = text.split(), gone[block.first_word[number] : block.first_word[number + 1]]
            n, n_gone = len(words), int(here.sum())
            kept = b" ".join([w for w, g in zip(words, here.tolist(), strict=True) if not g] if n_gone else words)
            rows.append((doc_id, n, n_gone, kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
        return out.astype({"doc_id": "Int64"})

    shared = by_block.applyInPandas(anchors_of_block, DEALT).groupBy("part").applyInPandas(shared_keys, DEALT)
    repeats = by_block.cogroup(shared.groupBy("block")).applyInPandas(windows_of_block, DEALT).groupBy("part").applyInPandas(shared_keys, DEALT)
    return by_block.cogroup(repeats.groupBy("block")).applyInPandas(kept_of_block, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


OP3_SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), windows as (
  select doc_id, w[s:s + 12] as seq, s from d, unnest(range(1, len(w) - 11)) as u(s) where len(w) >= 13
), firsts as (
  select seq, min(doc_id) as first_id from windows group by seq
), covered as (
  select distinct doc_id, unnest(range(s, s + 13)) as p from windows join firsts using (seq) where first_id < doc_id
), gone as (
  select doc_id, list(p) as ps from covered group by doc_id
), kept as (
  select d.doc_id, len(w) as n_words, coalesce(len(ps), 0) as n_removed,
    array_to_string([w[i] for i in range(1, len(w) + 1) if ps is null or not list_contains(ps, i)], ' ') as kept
  from d left join gone using (doc_id)
)
select doc_id, n_words, n_removed, sha256(kept) as kept_sha256 from kept
"""
