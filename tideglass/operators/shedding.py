"""Bounded-queue models: which events a slow consumer would lose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shed(df: DataFrame, burst: int, capacity: int, drop: str = "oldest", order: str = "arrival_seq") -> DataFrame:
    """Adds burst and is_dropped: of each burst of rows a queue holds `capacity`, shedding its oldest or newest.

    A burst is what arrives while the consumer is away, here a fixed number
    of consecutive arrivals.
    """
    direction = F.desc(order) if drop == "oldest" else F.asc(order)
    at = df.withColumn("burst", F.floor((F.col(order) - 1) / burst).cast("long"))
    rank = F.row_number().over(Window.partitionBy("burst").orderBy(direction))
    return at.withColumn("is_dropped", rank > capacity)


def drops(shedded: DataFrame) -> DataFrame:
    """Rows kept and dropped, and the deepest queue, per burst."""
    return shedded.groupBy("burst").agg(F.count_if(~F.col("is_dropped")).alias("kept"), F.count_if("is_dropped").alias("dropped"))


def rate_limited(df: DataFrame, per_second: float, order: str = "arrival_seq") -> DataFrame:
    """Adds send_ms: when a token bucket that starts empty lets each of a backlog of rows go; 0 without a rate.

    A backlog never lets tokens pile up, so the bucket's size does not show.
    """
    return df.withColumn("send_ms", F.col(order) * (1000.0 / per_second) if per_second > 0 else F.lit(0.0))


def sender_stats(sends: DataFrame, kept: int = 100_000) -> DataFrame:
    """Totals over connections: sent, errors, throughput, and latency percentiles of each one's first samples.

    Columns: connection, n (from 1), latency_ms, is_error, sent_ms.
    """
    from ..functions.ordering import order_statistic
    from ..functions.scalars import index_capped

    sums = sends.agg(F.count_if(~F.col("is_error")).alias("sent"), F.count_if("is_error").alias("errors"), ((F.max("sent_ms") - F.min("sent_ms")) / 1000.0).alias("elapsed_s"))
    out = sums.withColumn("throughput", F.when(F.col("elapsed_s") > 0, F.col("sent") / F.col("elapsed_s")).otherwise(0.0))
    sampled = sends.filter(~F.col("is_error") & (F.col("n") <= kept)).withColumn("all", F.lit(1))
    for p in (50, 95, 99):
        one = order_statistic(sampled, ["all"], "latency_ms", index_capped(p), f"p{p}").select(f"p{p}")
        out = out.crossJoin(F.broadcast(one))  # single rows
    return out
