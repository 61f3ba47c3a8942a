"""Token counts per document by a two-tier lookup, without any pre-token shuffle.

Tier one is a broadcast table of the frequent pre-tokens' lengths, encoded
once on the driver. Tier two encodes what the table lacks, in each Python
worker, behind a bounded cache. Both tiers only save work: every count is
that of the tokenizer itself.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The byte-level pre-tokenizer's pattern (fixed value of the format).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class may differ between Unicode versions: texts with one go to the library whole.
UNSETTLED = regex.compile(
    r"[՘֋֌࢏౜೜₏₝-₟꟎-꟱꭬꭭"
    r"\U00010000-\U0001f2ff\U0001f650-\U0001f8ff\U0001fa00-\U0010ffff]"
)

#: The table is drawn from about this many documents of at most SAMPLE_BYTES each, and holds TABLE_SIZE entries at most.
SAMPLE_DOCS, SAMPLE_BYTES, TABLE_SIZE = 1_000, 32_768, 65_536
#: A worker's cache holds this many pre-tokens of at most CACHE_CHARS characters, and is then begun anew.
CACHE_SIZE, CACHE_CHARS = 500_000, 64
#: Tokens above which a document is marked.
LIMIT = 1_024


class TwoTierCounter:
    """Counts tokens of texts with the library at hand for whatever the tiers lack."""

    def __init__(self, tokenizer_json: str, table: dict[str, int]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.table = table
        self.cache: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def encode_missing(self, pieces: Iterable[str]) -> dict[str, int]:
        pieces = list(pieces)
        found = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: len(e.ids) for p, e in zip(pieces, found, strict=True)}

    def plain(self, text: str) -> bool:
        """Whether the pattern cuts the text as the library would."""
        if any(s in text for s in self.special):
            return False
        return text.isascii() or UNSETTLED.search(text) is None

    def count(self, text: str) -> int:
        if not self.plain(text):
            return self.whole(text)
        pieces = PRE_TOKEN.findall(text)
        table, cache = self.table, self.cache
        try:  # most texts need the table and the cache only
            return sum([table[p] if p in table else cache[p] for p in pieces])
        except KeyError:
            pass
        missing = {p for p in pieces if p not in table and p not in cache}
        lengths = self.encode_missing(missing)
        total = sum([table[p] if p in table else cache[p] if p in cache else lengths[p] for p in pieces])
        if len(cache) + len(lengths) > CACHE_SIZE:
            cache.clear()
        cache.update((p, n) for p, n in lengths.items() if len(p) <= CACHE_CHARS)
        return total


def frequent_pre_tokens(texts: Iterable[str], size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pre-tokens; ties by code point."""
    counts = Counter(chain.from_iterable(map(PRE_TOKEN.findall, texts)))
    short = [(-n, p) for p, n in counts.items() if len(p) <= CACHE_CHARS]
    return [p for _, p in sorted(short)[:size]]


def sample_texts(docs: DataFrame, id_col: str, text_col: str, wanted: int) -> list[str]:
    """A bounded sample by hash of the id: about `wanted` texts, never over twice as many, none above SAMPLE_BYTES."""
    n_docs = docs.count()
    if not n_docs:
        return []
    share = min(1.0, wanted / n_docs)
    drawn = docs.filter((F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)) & (F.octet_length(text_col) <= SAMPLE_BYTES))
    return [r[0] for r in drawn.select(text_col).limit(2 * wanted).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer_path names a byte-level tokenizer file of the `tokenizers`
    library on the driver; its text is broadcast, so executors need no file.
    Null counts as the empty text, of 0 bytes and 0 tokens. Special strings
    in texts, and texts with unsettled characters, are counted by the library
    as they stand. Repeated rows and ids are counted each; other columns are
    not looked at; an empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    driver = TwoTierCounter(tokenizer_json, {})
    frequent = frequent_pre_tokens(sample_texts(docs, id_col, text_col, sample_docs))
    shared = spark.sparkContext.broadcast((tokenizer_json, driver.encode_missing(frequent)))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TwoTierCounter(*shared.value)
        for batch in batches:
            texts = batch.pop("text")
            yield batch.assign(n_tokens=[counter.count(t) for t in texts])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInPandas(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
