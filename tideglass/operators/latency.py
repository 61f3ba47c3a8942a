"""Latency histogram, percentiles and the sustained-spike detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import DEFAULTS, LATENCY_BUCKETS, EngineConfig
from ..functions.ordering import Running, last_rows, order_statistic, running, sliding_sum
from ..functions.scalars import age_ms, clamped_latency, index_capped, index_floor, index_nearest, pipe_ms, report_latency
from .ingest import for_vwap


def histogram(ticks: DataFrame) -> DataFrame:
    """(le, events) per bucket, cumulative; every bucket is there. Negative latencies are no samples."""
    latency = report_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms"))
    sums = ticks.agg(*[F.count_if(latency <= edge).alias(f"b{i}") for i, edge in enumerate(LATENCY_BUCKETS)], F.count(latency).alias("rest"))
    names = [*[(str(edge), f"b{i}") for i, edge in enumerate(LATENCY_BUCKETS)], ("+Inf", "rest")]
    return sums.select(F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.col(c).alias("events")) for le, c in names])).alias("b")).select("b.le", "b.events")


def latency_totals(ticks: DataFrame) -> DataFrame:
    """Sum, number, least and largest of the histogram's samples."""
    latency = report_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms"))
    return ticks.agg(F.coalesce(F.sum(latency), F.lit(0)).alias("latency_sum"), F.count(latency).alias("latency_count"), F.min(latency).alias("latency_min"), F.max(latency).alias("latency_max"))


def least_gauge(ticks: DataFrame) -> DataFrame:
    """The least-latency gauge that takes 0 as unset: a 0 is overwritten by the sample after it.

    So it is the least of the samples after the last 0, or 0 if that is the
    last sample; without a 0 the plain minimum.
    """
    latency = report_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms"))
    samples = ticks.select("arrival_seq", latency.alias("l")).filter("l is not null")
    last_zero = samples.agg(F.max(F.when(F.col("l") == 0, F.col("arrival_seq"))).alias("z"))
    after = samples.crossJoin(F.broadcast(last_zero)).filter("z is null or arrival_seq > z")  # one row on the right
    return after.agg(F.coalesce(F.min("l"), F.lit(0)).alias("latency_min_gauge"))


def percentiles_nearest(ticks: DataFrame, p: float = 99, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Age and pipe percentile of the last samples, by the nearest rank, as of the last receipt; 0 without samples."""
    valid = for_vwap(ticks)
    asof = ticks.agg(F.max("recv_ts_ms").alias("asof"))
    newest = valid.orderBy(F.desc("arrival_seq")).limit(config.latency_window).crossJoin(F.broadcast(asof))
    aged = newest.select(F.lit("age").alias("kind"), age_ms(F.col("ingest_ts_ms"), F.col("asof")).alias("ms"))
    piped = valid.filter("recv_ts_ms > 0").orderBy(F.desc("arrival_seq")).limit(config.latency_window).crossJoin(F.broadcast(asof))
    both = aged.unionByName(piped.select(F.lit("pipe").alias("kind"), pipe_ms(F.col("recv_ts_ms"), F.col("asof")).alias("ms")))
    return order_statistic(both, ["kind"], "ms", index_nearest(p), "p99").select("kind", F.col("p99").cast("double").alias("p99"), "n")


def percentiles_index(ticks: DataFrame) -> DataFrame:
    """p50, p95 and p99 of all latencies per symbol, by the truncated index."""
    latency = ticks.select("product_id", report_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms")).alias("ms")).filter("ms is not null")
    found = None
    for p in (50, 95, 99):
        one = order_statistic(latency, ["product_id"], "ms", index_capped(p) if p < 99 else index_floor(p), f"p{p}")
        found = one if found is None else found.join(one.drop("n"), "product_id")
    return found.select("product_id", "n", "p50", "p95", "p99")


def spikes(ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Adds sample (number among events with both times), over, is_breach and is_spike; only sampled events.

    The 99th percentile of the last samples is above the threshold iff more
    samples exceed it than lie above that rank, so counting takes the place
    of sorting. Of a run of breaches every second one fires.
    """
    latency = clamped_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms"))
    samples = ticks.withColumn("latency_ms", latency).filter("latency_ms is not null")
    over = (F.col("latency_ms") > config.spike_threshold_ms).cast("long")
    window = config.latency_window
    counted = last_rows(samples, [], "arrival_seq", window, {"over": sliding_sum(over, window)})
    n = F.least(F.col("__n"), F.lit(window))
    breach = (n >= config.latency_least) & (F.col("over") >= n - F.floor(n * 99 / 100))
    counted = counted.withColumn("is_breach", breach).withColumnRenamed("__n", "sample")
    counted = running(counted, [], "arrival_seq", {"__calm": Running("max", F.when(~F.col("is_breach"), F.col("sample")))})
    run = F.col("sample") - F.coalesce("__calm", F.lit(0))
    return counted.withColumn("is_spike", F.col("is_breach") & (run % config.spike_consecutive == 0)).drop("__calm")


def p99_at(samples: DataFrame, at: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Per row of at (seq, sample): p99 of the window that ends with that sample; 0 under ten samples.

    Each request takes its window by buckets of the sample number, an equi-join.
    """
    window = config.latency_window
    bucket = lambda c: F.floor(F.col(c) / window).cast("long")
    asked = at.select("seq", "sample", F.explode(F.sequence(F.floor(F.greatest(F.col("sample") - window + 1, F.lit(1)) / window).cast("long"), bucket("sample"))).alias("b"))
    held = samples.select(F.col("sample").alias("s"), "latency_ms", bucket("sample").alias("b"))
    within = asked.join(held, "b").filter((F.col("s") <= F.col("sample")) & (F.col("s") > F.col("sample") - window))
    return order_statistic(within, ["seq"], "latency_ms", index_floor(99), "p99").select("seq", F.when(F.col("n") < 10, F.lit(0)).otherwise(F.col("p99")).alias("p99"))

