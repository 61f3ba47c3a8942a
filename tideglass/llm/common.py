"""Shared pieces: scratch tables, skew-safe joins, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and the controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only up to this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_scratch: dict[str, str] = {}
_written: list[tuple[str, str]] = []
_owner = [""]


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is missing a local session gets a folder of its own;
    a cluster session is refused, as its machines share no local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_scratch:
        _own_scratch[context.applicationId] = tempfile.mkdtemp(prefix="tideglass-")
    return _own_scratch[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared scratch folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read, and several readers
    of the result see the very same rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((_owner[-1], path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_of(owner: str) -> Iterator[None]:
    """What materialize() writes inside belongs to the owner, who can have it removed before the rest."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def remove_scratch(spark: SparkSession, owner: str | None = None) -> int:
    """Deletes the tables (or an owner's) that materialize() wrote in this process; call it when results are stored. Returns how many."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for one in [w for w in _written if owner is None or w[0] == owner]:
        _written.remove(one)
        path = jvm.org.apache.hadoop.fs.Path(one[1])
        n += path.getFileSystem(conf).delete(path, True)
    return n


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """For jobs run inside: how many rows a Python worker is handed at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, parts: int = 1000, how: str = "left") -> DataFrame:
    """Join (left, or inner) of rows with one row per key, safe for keys that hold a large share of the rows.

    groups has the keys, the column `size` (rows of that key) and values.
    At most `parts` keys can hold more than total/parts rows, so those
    few are broadcast; all other keys are small and meet in a shuffle.
    Keys compare null-safe.
    """
    bound = max(1, total // parts)
    values = [c for c in groups.columns if c not in keys]
    renamed = groups.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *values)

    def on(left: DataFrame, right: DataFrame) -> Column:
        same = F.lit(True)
        for k in keys:
            same = same & left[k].eqNullSafe(right[f"__g_{k}"])
        return same

    hot = F.broadcast(renamed.filter(F.col(size) > bound))
    cool = renamed.filter(F.col(size) <= bound)
    drop = [f"__g_{k}" for k in keys]
    in_hot = rows.join(hot, on(rows, hot), "inner").drop(*drop)
    # for an inner join the two sets of keys part the rows by themselves
    rest = rows if how == "inner" else rows.join(hot.select(*drop), on(rows, hot), "left_anti")
    return in_hot.unionByName(rest.join(cool, on(rest, cool), how).drop(*drop))


def with_row_key(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """docs (or some of its columns) with __row, a 64-bit number of each row that is the same whenever they are read.

    A table read from files is numbered by file and place in it; any other
    frame is written once with its numbers.
    """
    columns = [c for c in columns or docs.columns if c != "__row"]
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            keyed = docs.withColumn("__row", F.xxhash64("_metadata.file_path", "_metadata.row_index")).select(*columns, "__row")
            keyed.schema  # noqa: B018
            return keyed
        except AnalysisException:
            pass
    return materialize(docs.select(*columns, F.monotonically_increasing_id().alias("__row")), "keyed")


def without_rows(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """with_row_key()'s frame less the rows whose __row is in rows (materialised, one column), and less that column."""
    return without_ids(keyed, rows, "__row").drop("__row")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in ids (materialised, one column); null ids stay.

    The ids are broadcast when there are few, else both sides are shuffled.
    """
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
