"""Metric snapshots, their text exposition, and the dashboard's expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import ANOMALY_LABELS, LATENCY_BUCKETS
from ..functions.scalars import report_latency

#: Flags of judged ticks, and the names of the anomalies they mark.
ANOMALIES = {"is_duplicate": "duplicate", "is_out_of_order": "ooo", "is_gap": "gap", "is_drift": "drift", "is_spike": "latency_spike"}
#: Kind of each exported metric, and its help text (fixed values of the format).
METRICS = {
    "events_total": ("counter", "Total events processed"),
    "events_per_second": ("gauge", "Current events per second"),
    "drops_total": ("counter", "Total dropped events"),
    "anomalies_total": ("counter", "Total anomalies detected by type"),
    "incidents_total": ("counter", "Total incidents captured"),
    "latency_ms": ("histogram", "Event latency histogram"),
    "queue_depth_max": ("gauge", "Maximum queue depth across consumers"),
}


def snapshots(ticks: DataFrame, step_ms: int) -> DataFrame:
    """Long-format counters (at_ms, name, label, value), as scraped every step_ms of receipt.

    Events are summed per step first; only those sums are accumulated.
    Steps without events have no sample. Ticks that carry flags have series
    for their anomalies and incidents too; events_per_second is a gauge, of
    the step alone.
    """
    marks = [("anomalies_total", ANOMALY_LABELS[label], c) for c, label in ANOMALIES.items() if c in ticks.columns]
    marks += [("incidents_total", "", "is_incident")] * ("is_incident" in ticks.columns)
    latency = report_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms"))
    step = F.floor(F.col("recv_ts_ms") / step_ms).cast("long") * step_ms + step_ms
    sums = ticks.groupBy(step.alias("at_ms")).agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(latency), F.lit(0)).alias("sum"),
        F.count(latency).alias("count"),
        *[F.count_if(latency <= edge).alias(f"b{i}") for i, edge in enumerate(LATENCY_BUCKETS)],
        *[F.count_if(F.col(c)).alias(c) for _, _, c in marks],
    )
    upto = Window.orderBy("at_ms").rowsBetween(Window.unboundedPreceding, 0)
    names = [("events_total", "", "events"), ("latency_ms_sum", "", "sum"), ("latency_ms_count", "", "count"), ("latency_ms_bucket", "+Inf", "count")]
    names += [("latency_ms_bucket", str(edge), f"b{i}") for i, edge in enumerate(LATENCY_BUCKETS)] + marks
    gauge = (F.col("events") / (step_ms / 1000.0)).alias("eps")
    total = sums.select("at_ms", *[F.sum(c).over(upto).cast("double").alias(c) for c in dict.fromkeys(c for _, _, c in names)], gauge)
    names.append(("events_per_second", "", "eps"))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(label).alias("label"), F.col(c).alias("value")) for n, label, c in names])
    return total.select("at_ms", F.explode(pairs).alias("m")).select("at_ms", "m.name", "m.label", "m.value")


def increase(samples: DataFrame, window_ms: int) -> DataFrame:
    """Adds increase and rate (per second) over the window that ends with each sample.

    A value under the one before is a counter that began anew: it counts
    whole. Both are 0 with a single sample in the window.
    """
    series = Window.partitionBy("name", "label").orderBy("at_ms")
    before = F.lag("value").over(series)
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    ranged = series.rangeBetween(-window_ms, 0)
    grown = samples.withColumn("__d", step)
    first = F.first("__d").over(ranged)
    found = grown.withColumns({"increase": F.sum("__d").over(ranged) - first, "__ms": F.col("at_ms") - F.min("at_ms").over(ranged)})
    return found.withColumn("rate", F.when(F.col("__ms") > 0, F.col("increase") / (F.col("__ms") / 1000.0)).otherwise(0.0)).drop("__d", "__ms")


def bands(value: Column, yellow: float, red: float) -> Column:
    return F.when(value >= red, "red").when(value >= yellow, "yellow").otherwise("green")


def mean_latency(samples: DataFrame) -> DataFrame:
    """Latest latency sum over count, with its band."""
    pick = lambda n: F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("at_ms")))
    both = samples.agg(pick("latency_ms_sum").alias("s"), pick("latency_ms_count").alias("c"))
    mean = F.when(F.col("c") > 0, F.col("s") / F.col("c")).otherwise(0.0)
    return both.select(mean.alias("mean_latency_ms"), bands(mean, 10, 50).alias("band"))


def latest(samples: DataFrame) -> DataFrame:
    """The last value of every series."""
    return samples.groupBy("name", "label").agg(F.max_by("value", "at_ms").alias("value"))


def histogram_quantile(samples: DataFrame, q: float, window_ms: int) -> DataFrame:
    """(at_ms, quantile) of the bucket rates: linear within the bucket the rank falls in.

    The first bucket starts at 0; a rank in the unbounded bucket gives the
    last bound. Null where nothing was observed.
    """
    rates = increase(samples.filter("name = 'latency_ms_bucket'"), window_ms)
    edge = F.when(F.col("label") == "+Inf", F.lit(float("inf"))).otherwise(F.col("label").try_cast("double"))
    rows = rates.withColumn("edge", edge)
    by = Window.partitionBy("at_ms").orderBy("edge")
    rows = rows.withColumns({"low": F.coalesce(F.lag("edge").over(by), F.lit(0.0)), "under": F.coalesce(F.lag("rate").over(by), F.lit(0.0)), "total": F.max("rate").over(Window.partitionBy("at_ms"))})
    rank = F.lit(q) * F.col("total")
    first = rows.filter((F.col("rate") >= rank) & (F.col("total") > 0)).groupBy("at_ms").agg(F.min_by(F.struct("edge", "low", "under", "rate", "total"), "edge").alias("b"))
    b = lambda c: F.col(f"b.{c}")
    inside = b("low") + (b("edge") - b("low")) * (F.lit(q) * b("total") - b("under")) / (b("rate") - b("under"))
    value = F.when(b("edge") == float("inf"), b("low")).when(b("rate") == b("under"), b("low")).otherwise(inside)
    return first.select("at_ms", value.alias("quantile"))


def queue_totals(drops: DataFrame) -> DataFrame:
    """(drops, depth): all rows that shed queues dropped, and the most that one held; 0 without any."""
    return drops.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("drops"), F.coalesce(F.max("kept"), F.lit(0)).alias("depth"))


def exposition(ticks: DataFrame, counted: DataFrame, histogram: DataFrame, queues: DataFrame, prefix: str = "tideglass") -> DataFrame:
    """(place, line): the text form of all metrics, histogram buckets cumulative; queues is queue_totals().

    events_per_second is over the whole span of receipt.
    """
    latency = report_latency(F.col("ingest_ts_ms"), F.col("recv_ts_ms"))
    span = (F.max("recv_ts_ms") - F.min("recv_ts_ms")) / 1000.0
    totals = ticks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(latency), F.lit(0)).alias("s"), F.count(latency).alias("c"), F.when(span > 0, F.count(F.lit(1)) / span).otherwise(0.0).alias("eps"))
    buckets = histogram.agg(F.map_from_entries(F.collect_list(F.struct("le", "events"))).alias("h"))
    one = totals.crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(buckets)).crossJoin(F.broadcast(queues))  # four single rows
    long = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    lines: list[Column] = []

    def head(name: str) -> None:
        kind, text = METRICS[name]
        lines.extend([F.lit(f"# HELP {prefix}_{name} {text}"), F.lit(f"# TYPE {prefix}_{name} {kind}")])

    def sample(name: str, value: Column, label: str = "") -> None:
        lines.append(F.concat(F.lit(f"{prefix}_{name}{label} "), value))

    head("events_total"), sample("events_total", long("n")), lines.append(F.lit(""))
    head("events_per_second"), sample("events_per_second", F.format_string("%.2f", "eps")), lines.append(F.lit(""))
    head("drops_total"), sample("drops_total", long("drops")), lines.append(F.lit(""))
    head("anomalies_total")
    for column, label in (("duplicates", "duplicate"), ("out_of_order", "out_of_order"), ("gaps", "sequence_gap"), ("drift", "schema_drift"), ("spikes", "latency_spike")):
        sample("anomalies_total", long(column), f'{{type="{label}"}}')
    lines.append(F.lit(""))
    head("incidents_total"), sample("incidents_total", long("incidents")), lines.append(F.lit(""))
    head("latency_ms")
    for edge in [*map(str, LATENCY_BUCKETS), "+Inf"]:
        sample("latency_ms_bucket", long(F.col("h")[edge]), f'{{le="{edge}"}}')
    sample("latency_ms_sum", long("s")), sample("latency_ms_count", long("c")), lines.append(F.lit(""))
    head("queue_depth_max"), sample("queue_depth_max", long("depth"))
    return one.select(F.posexplode(F.array(*lines)).alias("place", "line"))
