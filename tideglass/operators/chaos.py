"""Seeded fault injection: shuffle, duplicate, drift, re-stamp, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered

#: The six kinds of drift, by number.
KINDS = ("missing_price", "missing_type", "wrong_price_type", "wrong_size_type", "extra_field", "missing_multiple")


def draw(seed: int, salt: int, *columns: str) -> Column:
    """A number in [0, 1) from the row's own values: the same on every run and any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *columns), F.lit(1 << 30)) / float(1 << 30)


def shuffle(df: DataFrame, chunk: int, seed: int = 0, order: str = "arrival_seq") -> DataFrame:
    """Permutes rows within consecutive chunks of `chunk` rows, by renumbering `order`; up to 1 leaves them."""
    if chunk <= 1:
        return df
    placed = numbered(df, [], order, "__n").withColumn("__c", F.floor((F.col("__n") - 1) / chunk).cast("long"))
    rank = F.row_number().over(Window.partitionBy("__c").orderBy(draw(seed, 1, order), order))
    return placed.withColumn(order, F.col("__c") * chunk + rank).drop("__n", "__c")


def duplicate(df: DataFrame, rate: float, seed: int = 0, order: str = "arrival_seq") -> DataFrame:
    """Copies a share of the rows, each copy right after its row; `order` is numbered anew."""
    if rate <= 0:
        return df
    copies = F.when(draw(seed, 2, order) < rate, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = df.withColumn("__o", F.explode(copies)).withColumn("__o", F.col(order) * 2 + F.col("__o"))
    return numbered(spread.drop(order), [], "__o", order).drop("__o")


def inject_drift(df: DataFrame, rate: float, seed: int = 0, order: str = "arrival_seq", raw: str = "raw") -> DataFrame:
    """Breaks a share of the JSON texts in one of six ways; adds injected (the kind's number, -1 for none)."""
    kind = F.when(draw(seed, 3, order) < rate, F.floor(draw(seed, 4, order) * len(KINDS)).cast("int")).otherwise(F.lit(-1))
    held = df.withColumn("injected", kind).withColumn("__m", F.from_json(raw, "map<string,variant>"))
    gone = F.when(F.col("injected") == 0, F.array(F.lit("price"))).when(F.col("injected") == 1, F.array(F.lit("type")))
    gone = gone.when(F.col("injected") == 5, F.array(F.lit("price"), F.lit("last_size"))).otherwise(F.array().cast("array<string>"))
    kept = F.map_filter("__m", lambda k, _: ~F.array_contains(gone, k))

    def changed(key: Column, value: Column) -> Column:
        quoted = ((F.col("injected") == 2) & (key == "price")) | ((F.col("injected") == 3) & (key == "last_size"))
        return F.when(quoted, F.parse_json(F.concat(F.lit('"'), value.cast("string"), F.lit('"')))).otherwise(value)

    more = F.from_json(F.when(F.col("injected") == 4, '{"unexpected_field":"drift_test","another_field":12345}').otherwise("{}"), "map<string,variant>")
    edited = F.map_concat(F.transform_values(kept, changed), more)
    return held.withColumn(raw, F.when(F.col("injected") < 0, F.col(raw)).otherwise(F.to_json(edited))).drop("__m")


def restamp(df: DataFrame, at: Column) -> DataFrame:
    return df.withColumn("ingest_ts_ms", at)
