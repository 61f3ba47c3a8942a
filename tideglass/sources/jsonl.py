"""JSON-lines files, incident bundles, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import report as reporting
from ..operators.drift import drift_samples

#: Typed columns of a tick in JSON.
TICK_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("last_size", T.DoubleType()),
        T.StructField("time", T.StringType()),
        T.StructField("trade_id", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("ingest_ts_ms", T.LongType()),
        T.StructField("recv_ts_ms", T.LongType()),
    ]
)
META_SCHEMA = "incident_id string, reason string, timestamp string, pre_events long, post_events long, total_events long"


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((line_no, raw), rejects): the JSON lines of text files in order; blank lines are skipped, malformed ones set aside.

    line_no follows file name, then place in the file.
    """
    lines = spark.read.text(path).withColumn("__f", F.col("_metadata.file_path")).withColumn("__m", F.monotonically_increasing_id())
    lines = lines.filter(F.trim("value") != "")
    good = F.try_parse_json("value").isNotNull()
    # ids rise along a file; files are told apart by name
    in_file = F.row_number().over(Window.partitionBy("__f").orderBy("__m"))
    kept = lines.filter(good).withColumn("__n", in_file)
    sizes = kept.groupBy("__f").agg(F.max("__n").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__f", before.alias("__o"))
    numbered = kept.join(offsets, "__f").select((F.col("__n") + F.col("__o")).alias("line_no"), F.trim("value").alias("raw"))
    return numbered, lines.filter(~good).select("value")


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines ticks as typed columns; malformed lines are dropped."""
    return spark.read.schema(TICK_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_bundles(meta: DataFrame, events: DataFrame, path: str) -> None:
    """Incident bundles below path: events/ as JSON lines in capture order, meta/ as one JSON row each, by incident_id."""
    events.repartition("incident_id").sortWithinPartitions("incident_id", "arrival_seq").write.mode("overwrite").partitionBy("incident_id").json(f"{path}/events")
    meta.repartition("incident_id").write.mode("overwrite").json(f"{path}/meta")


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(meta, events) of all bundles below path; a bundle without a readable meta row is left out."""
    meta = spark.read.schema(META_SCHEMA).option("mode", "DROPMALFORMED").json(f"{path}/meta").filter("incident_id is not null").orderBy("incident_id")
    schema = T.StructType([T.StructField("arrival_seq", T.LongType()), *TICK_SCHEMA.fields, T.StructField("incident_id", T.StringType())])
    events = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/events")
    return meta, events.join(meta.select("incident_id"), "incident_id", "left_semi")


def report_texts(spark: SparkSession, path: str, incident_ids: list[str] | None = None, analysis: dict[str, str] | None = None) -> dict[str, str]:
    """Markdown of the named incidents below path (default: all), one collected report row each."""
    meta, events = read_bundles(spark, path)
    rows = reporting.reports(meta, events)
    if incident_ids is not None:
        rows = rows.filter(F.col("incident_id").isin(incident_ids))
    return {r["incident_id"]: reporting.markdown(r.asDict(recursive=True), (analysis or {}).get(r["incident_id"])) for r in rows.toLocalIterator()}


def write_reports(spark: SparkSession, path: str, out: str | None = None, incident_ids: list[str] | None = None, analysis: dict[str, str] | None = None) -> None:
    """One Markdown file per incident below out (default: reports/ in path), partitioned by incident_id; a rerun replaces them."""
    texts = report_texts(spark, path, incident_ids, analysis)
    rows = spark.createDataFrame(sorted(texts.items()), "incident_id string, value string")
    rows.repartition("incident_id").write.mode("overwrite").partitionBy("incident_id").text(out or f"{path}/reports")


def write_drift_samples(df: DataFrame, path: str, most: int | None = None) -> None:
    """All drifted events with their findings as JSON lines; only the first `most` in order if given, as a full queue would keep."""
    found = drift_samples(df)
    if most is not None:
        found = found.orderBy("arrival_seq").limit(most)
    found.write.mode("append").json(path)


def record(stream: DataFrame, path: str, checkpoint: str, every: str = "1 second", once: bool = False):
    """Appends a stream of events as JSON lines; nothing is dropped, a restart goes on from the checkpoint."""
    writer = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
