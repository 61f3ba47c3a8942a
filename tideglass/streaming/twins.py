"""Streaming runs over a batch of ticks, for comparison with the batch forms.

The ticks are written as JSON-lines files in arrival order, streamed with
one file per micro-batch, and the sink's rows are read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.config import DEFAULTS, EngineConfig
from ..functions.scratch import shared_dir
from ..operators.integrity import flags
from ..sources.jsonl import TICK_SCHEMA
from . import state

STREAM_SCHEMA = T.StructType([T.StructField("arrival_seq", T.LongType()), *TICK_SCHEMA.fields])
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def written(ticks: DataFrame, name: str, files: int, schema: T.StructType = STREAM_SCHEMA) -> str:
    """Writes ticks as `files` JSON files one after the other, as a file stream reads the older first; returns the folder."""
    path = shared_dir(ticks.sparkSession, name)
    rows = ticks.select(*[f.name for f in schema.fields])
    first, last = ticks.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    step = -(-(last - first + 1) // files) if last is not None else 1
    for k in range(files):
        part = rows.filter(F.col("arrival_seq").between((first or 0) + k * step, (first or 0) + (k + 1) * step - 1))
        part.coalesce(1).sortWithinPartitions("arrival_seq").write.mode("append").json(path)
    return path


def run(spark: SparkSession, ticks: DataFrame, name: str, build: Callable[[DataFrame], DataFrame], files: int = 2, mode: str = "append", schema: T.StructType = STREAM_SCHEMA) -> DataFrame:
    """Streams ticks through build() to a Parquet sink and returns its rows."""
    source = written(ticks, f"{name}-in", files, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(source)
    out, checkpoint = shared_dir(spark, f"{name}-out"), shared_dir(spark, f"{name}-checkpoint")
    built = build(stream)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = built.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(built.schema).parquet(out)


def stream_volume(spark: SparkSession, ticks: DataFrame) -> DataFrame:
    """The windowed volume. A last, far later row without a price closes every window."""
    last = ticks.agg(F.max("arrival_seq").alias("a"), F.max("recv_ts_ms").alias("r"))
    closing = last.select((F.col("a") + 1).alias("arrival_seq"), F.lit("ticker").alias("type"), F.lit("~").alias("product_id"), F.lit(1.0).alias("price"), F.lit(1.0).alias("last_size"), (F.col("r") + 86_400_000).alias("recv_ts_ms"))
    rows = ticks.unionByName(closing, allowMissingColumns=True)
    # rows come in chunk order, hence the generous lateness
    found = run(spark, rows, "volume", lambda s: state.volume_stream(s, lateness="6 hours"), files=3)
    return found.filter("product_id <> '~'")


def stream_flags(spark: SparkSession, ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    return run(spark, ticks, "flags", lambda s: state.integrity_stream(s, config))


def stream_vwap(spark: SparkSession, ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    return run(spark, ticks, "vwap", lambda s: state.vwap_stream(s, config))


def stream_incidents(spark: SparkSession, ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Completed captures, from ticks flagged in batch."""
    schema = T.StructType([*STREAM_SCHEMA.fields, T.StructField("is_duplicate", T.BooleanType()), T.StructField("is_gap", T.BooleanType())])
    return run(spark, flags(ticks), "incidents", lambda s: state.recorder_stream(s, config), schema=schema)
