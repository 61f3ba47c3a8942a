"""The flight recorder: which anomalies open an incident, and the events around it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import DEFAULTS, EngineConfig
from ..functions.scratch import stored
from .integrity import flags
from .latency import p99_at, spikes


def triggers(ticks: DataFrame, config: EngineConfig = DEFAULTS, spiked: DataFrame | None = None) -> DataFrame:
    """(seq, recv_ms, kind): events that ask for a capture, by priority spike, duplicate, gap; spiked: spikes() of the ticks, if at hand."""
    fired = (spikes(ticks, config) if spiked is None else spiked).filter("is_spike").select(F.col("arrival_seq").alias("__seq"))
    flagged = flags(ticks)
    marked = flagged.join(fired, flagged["arrival_seq"] == fired["__seq"], "left")
    kind = F.when(F.col("__seq").isNotNull(), "latency_spike").when(F.col("is_duplicate"), "duplicate").when(F.col("is_gap"), "gap")
    return marked.select(F.col("arrival_seq").alias("seq"), F.col("recv_ts_ms").alias("recv_ms"), kind.alias("kind")).filter("kind is not null")


def resolve(candidates: DataFrame, last_seq: int | None, config: EngineConfig = DEFAULTS, flush_partial: bool = False) -> DataFrame:
    """(seq, recv_ms, kind, lo, hi): the captures that the recorder would complete.

    While one capture runs, and within the cooldown (by receipt), triggers
    are ignored; a capture's ring starts empty after the one before. One
    task folds over the sorted, three-column candidates batch by batch,
    holding the last capture only, as each decision depends on the one
    before. flush_partial keeps a capture that the data's end cuts off.
    """
    pre, post, cooldown = config.pre_events, config.post_events, config.cooldown_ms

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, last = 0, None
        for batch in batches:
            rows = []
            for seq, recv, kind in batch.itertuples(index=False):
                if seq < end or (last is not None and recv - last < cooldown):
                    continue
                lo, hi = max(end + 1, seq - pre + 1), seq + post
                rows.append((seq, recv, kind, seq + 1 if lo > seq else lo, hi))
                end, last = hi, recv
            yield pd.DataFrame(rows, columns=["seq", "recv_ms", "kind", "lo", "hi"])

    # a shuffle, so that only the fold itself is one task
    ordered = candidates.select("seq", "recv_ms", "kind").repartition(1).sortWithinPartitions("seq")
    found = ordered.mapInPandas(fold, "seq long, recv_ms long, kind string, lo long, hi long")
    if last_seq is None:
        return found
    return found.withColumn("hi", F.least("hi", F.lit(last_seq))) if flush_partial else found.filter(F.col("hi") <= last_seq)


def incidents(ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """resolve() on a frame of ticks, with reason and a name that is the same on every run.

    The samples and the incidents found are written once, as several steps read them.
    """
    last_seq = ticks.agg(F.max("arrival_seq")).first()[0]
    samples = stored(spikes(ticks, config).select("arrival_seq", "sample", "latency_ms", "is_spike"), "samples")
    found = stored(resolve(triggers(ticks, config, samples), last_seq, config), "captures")
    asked = found.filter("kind = 'latency_spike'").join(samples, F.col("seq") == F.col("arrival_seq")).select("seq", "sample")
    p99 = p99_at(samples, asked, config)
    reason = F.when(F.col("kind") == "latency_spike", F.format_string("latency_spike_p99=%dms", "p99"))
    reason = reason.when(F.col("kind") == "duplicate", "duplicate_detected").otherwise("sequence_gap")
    named = found.join(p99, "seq", "left").withColumn("reason", reason)
    stamp = F.date_format(F.timestamp_millis("recv_ms"), "yyyyMMdd_HHmmss")
    identity = F.left(F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "reason"), 256), F.lit(8))
    return named.select(F.concat_ws("_", stamp, identity).alias("incident_id"), "seq", "recv_ms", "reason", "lo", "hi")


def capture(ticks: DataFrame, found: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The events of each incident: ticks with incident_id in front.

    Intervals are dealt to buckets of their own length, so the range join is
    an equi-join and no side is broadcast.
    """
    width = config.pre_events + config.post_events
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    dealt = found.select("incident_id", "lo", "hi", F.explode(F.sequence(bucket("lo"), bucket("hi"))).alias("__b"))
    rows = ticks.withColumn("__b", bucket("arrival_seq")).join(dealt, "__b")
    return rows.filter((F.col("arrival_seq") >= F.col("lo")) & (F.col("arrival_seq") <= F.col("hi"))).select("incident_id", *ticks.columns)


def meta(found: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """What a bundle's meta file says. post_events is total less the configured pre_events, so it may be negative."""
    total = F.col("hi") - F.col("lo") + 1
    return found.select(
        "incident_id",
        "reason",
        F.date_format(F.timestamp_millis("recv_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.least(total, F.lit(config.pre_events)).alias("pre_events"),
        (total - config.pre_events).alias("post_events"),
        total.alias("total_events"),
    )
