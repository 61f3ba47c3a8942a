"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so; each chunk becomes a
fixed-size identifier, verified to stand for one content only; texts are
equal when their ordered identifier lists are. Distinct chunks move through
one shuffle, once per map task; after that only the lists move.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_groups, materialize, with_row_key, without_rows

#: A chunk ends at the first sentence or line end past 1,024 characters, or at 8,192.
CHUNK_PATTERN = r"(?s).{1024,8191}?[.!?\n]|.{1,8192}"


def hash_pair(chunk: Column) -> Column:
    """128 bits from two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(20_011), chunk).alias("b"))


def content(chunk: Column) -> Column:
    """The chunk itself: never ambiguous, and as long as the chunk."""
    return chunk


#: Tried in this order until one is free of collisions; the last always is.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (hash_pair, content)


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; they join to the text. None for an empty text."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def ambiguous(docs: DataFrame, identifier: Callable[[Column], Column]) -> bool:
    """Whether two different chunks of docs.norm share an identifier."""
    found = docs.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(identifier(F.col("chunk")).alias("id"), "chunk")
    distinct = found.groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    return not distinct.groupBy("id").count().filter("count > 1").isEmpty()


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """One row per input row: row (a number), doc_id, text_sha256, recipe (list of verified identifiers)."""
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    for identifier in identifiers:
        if identifier is content or not ambiguous(norm, identifier):
            break
    else:
        identifier = content
    return materialize(
        norm.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2(F.col("norm"), 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm")), identifier).alias("recipe"),
        ),
        "recipes",
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts one row stays, of the largest doc_id; a null id is
    less than any other, and of rows that repeat an id one stays. An empty
    table gives an empty result; other columns are not looked at.
    """
    found = recipes(docs, id_col, text_col, identifiers)
    groups = found.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("row", F.coalesce("doc_id", F.lit(-(2**63)))).alias("keep_row"),
        F.count(F.lit(1)).alias("group_size"),
    )
    return join_groups(found, groups, ["recipe"], "group_size", found.count()).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of equal texts the row of largest doc_id; a null id is less than any other, and of equal ids one row stays."""
    keyed = with_row_key(docs)
    found = recipes(keyed.withColumn("__place", F.struct("doc_id", "__row")), id_col="__place")
    best = found.groupBy("recipe").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("group_size"))
    placed = join_groups(found, best.filter("group_size > 1"), ["recipe"], "group_size", found.count(), how="inner")
    dropped = placed.filter("doc_id.__row <> best.__row").select("doc_id.__row")
    return without_rows(keyed, materialize(dropped, "copies"))


OP8_SQL = r"""
with norm as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), grouped as (
  select t, max(doc_id) as keep_id, count(*) as group_size from norm group by t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from norm join grouped using (t)
"""
