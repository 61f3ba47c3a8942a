"""The periodic log lines of each analysis, as text columns: (at_ms, line), one per step of receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(rows: DataFrame, piece: Column) -> DataFrame:
    """One line per at_ms, its symbols in order."""
    pieces = F.array_sort(F.collect_list(F.struct("product_id", piece.alias("p"))))
    return rows.groupBy("at_ms").agg(F.array_join(F.transform(pieces, lambda x: x["p"]), " | ").alias("line"))


def vwap_lines(snapshots: DataFrame) -> DataFrame:
    """From vwap_periodic()."""
    return _joined(snapshots, F.format_string("%s=%.2f", "product_id", "vwap"))


def volatility_lines(snapshots: DataFrame) -> DataFrame:
    """From volatility_periodic()."""
    return _joined(snapshots, F.format_string("%s=%.1f%%", "product_id", "volatility_pct"))


def volume_lines(windows: DataFrame, step_ms: int) -> DataFrame:
    """From volume()."""
    rows = windows.withColumn("at_ms", F.col("window_start_ms") + step_ms)
    return _joined(rows, F.format_string("%s=$%.1fK/min(%dtx)", "product_id", F.col("volume_per_minute") / 1000.0, "trades"))


def health_lines(windows: DataFrame, step_ms: int) -> DataFrame:
    """From health()."""
    line = F.format_string("eps=%.1f | price=%s", "events_per_second", F.coalesce(F.col("last_price"), F.lit(0.0)).cast("string"))
    return windows.select((F.col("window_start_ms") + step_ms).alias("at_ms"), line.alias("line"))


def forensics_lines(samples: DataFrame) -> DataFrame:
    """From snapshots() of marked ticks: the counters' values so far."""
    series = {"processed": ("events_total", ""), "drift": ("anomalies_total", "schema_drift"), "dup": ("anomalies_total", "duplicate")}
    series |= {"ooo": ("anomalies_total", "out_of_order"), "gaps": ("anomalies_total", "sequence_gap"), "spikes": ("anomalies_total", "latency_spike"), "incidents": ("incidents_total", "")}
    values = [F.coalesce(F.max(F.when((F.col("name") == name) & (F.col("label") == label), F.col("value"))), F.lit(0.0)).cast("long") for name, label in series.values()]
    return samples.groupBy("at_ms").agg(F.format_string(" | ".join(f"{k}=%d" for k in series), *values).alias("line"))
