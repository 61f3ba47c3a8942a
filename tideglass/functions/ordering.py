"""Order-dependent computations that scale with the rows and not with the largest key.

A window over one symbol, or over all events, would put that symbol or
everything into one task. Here the order is cut into blocks: each block is
aggregated, the few block totals are accumulated, and rows are then windowed
within (key, block) only. Frames of the last N rows take a halo of N rows
from the block before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order numbers, or rows, per block.
BLOCK = 200_000


@dataclass(frozen=True)
class Running:
    """A running aggregate: kind is sum, max, last (non-null) or count."""

    kind: str
    value: Column
    include_current: bool = True


def _partial(spec: Running, order: str) -> Column:
    if spec.kind == "sum":
        return F.sum(spec.value)
    if spec.kind == "max":
        return F.max(spec.value)
    if spec.kind == "count":
        return F.count(spec.value)
    return F.max_by(spec.value, F.when(spec.value.isNotNull(), F.col(order)))


def _windowed(spec: Running, window, value: Column | None = None) -> Column:
    value = spec.value if value is None else value
    if spec.kind == "sum":
        return F.sum(value).over(window)
    if spec.kind == "max":
        return F.max(value).over(window)
    if spec.kind == "count":
        return F.count(value).over(window) if value is spec.value else F.sum(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def _combined(spec: Running, before: Column, here: Column) -> Column:
    if spec.kind == "max":
        return F.greatest(before, here)
    if spec.kind == "last":
        return F.coalesce(here, before)
    zero = F.lit(0)
    return F.when(before.isNull() & here.isNull(), F.lit(None)).otherwise(F.coalesce(before, zero) + F.coalesce(here, zero))


def running(df: DataFrame, keys: list[str], order: str, specs: dict[str, Running], block: int = BLOCK) -> DataFrame:
    """Adds running aggregates in `order` (a unique number) for each key; sum and count are 0 before any row."""
    marked = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    at = [*keys, "__block"]
    totals = marked.groupBy(*at).agg(*[_partial(s, order).alias(f"__t_{n}") for n, s in specs.items()])
    by_block = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__k_{c}") for c in at], *[_windowed(s, by_block, F.col(f"__t_{n}")).alias(f"__b_{n}") for n, s in specs.items()])
    same = F.lit(True)
    for c in at:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = marked.join(before, same, "left").drop(*[f"__k_{c}" for c in at])
    base = Window.partitionBy(*at).orderBy(order)
    for name, spec in specs.items():
        frame = base.rowsBetween(Window.unboundedPreceding, 0 if spec.include_current else -1)
        value = _combined(spec, F.col(f"__b_{name}"), _windowed(spec, frame))
        joined = joined.withColumn(name, F.coalesce(value, F.lit(0)) if spec.kind in ("sum", "count") else value)
    return joined.drop("__block", *[f"__b_{n}" for n in specs])


def numbered(df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the 1-based row number in `order` for each key."""
    return running(df, keys, order, {name: Running("count", F.lit(1))}, block).withColumn(name, F.col(name).cast("long"))


def with_halo(df: DataFrame, number: str, rows: int, block: int = BLOCK) -> DataFrame:
    """Deals rows to blocks by row number, each block with the `rows` rows before it: adds __block and __halo."""
    block = max(block, rows)
    at = F.floor((F.col(number) - 1) / block).cast("long")
    own = F.struct(at.alias("b"), F.lit(False).alias("h"))
    after = F.struct((at + 1).alias("b"), F.lit(True).alias("h"))
    last = (F.col(number) - 1) % block >= block - rows
    spread = df.withColumn("__at", F.explode(F.when(last, F.array(own, after)).otherwise(F.array(own))))
    return spread.withColumns({"__block": F.col("__at.b"), "__halo": F.col("__at.h")}).drop("__at")


def last_rows(df: DataFrame, keys: list[str], order: str, rows: int, columns: dict[str, object], lookback: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds columns over the last `rows` rows of each key.

    columns: name -> function of (window spec ordered within key and block),
    which may look back up to rows + lookback rows. Adds __n, the row number.
    """
    dealt = with_halo(numbered(df, keys, order, "__n", block), "__n", rows + lookback, block)
    window = Window.partitionBy(*keys, "__block").orderBy(order)
    for name, build in columns.items():
        dealt = dealt.withColumn(name, build(window))
    return dealt.filter(~F.col("__halo")).drop("__block", "__halo")


def sliding_sum(value: Column, rows: int):
    """For last_rows: the sum of `rows` rows as a difference of running sums, exact for decimals and integers."""

    def build(window) -> Column:
        total = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
        dropped = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -rows))
        return total - F.coalesce(dropped, F.lit(0))

    return build


def order_statistic(df: DataFrame, keys: list[str], value: str, index: Column, name: str) -> DataFrame:
    """Per key the value at a 0-based index into its sorted values; index may use column n (their number).

    Works on counts of distinct values, so no list of values is ever built.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ordered, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    upto = counts.withColumns({"__u": F.sum("__c").over(ordered), "n": F.sum("__c").over(whole)})
    return upto.withColumn("__i", index).filter(F.col("__u") > F.col("__i")).groupBy(*keys).agg(F.min(value).alias(name), F.max("n").alias("n"))
