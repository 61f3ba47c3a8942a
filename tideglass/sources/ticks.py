"""Ticks derived from the events table: duplicates, gaps, late and slow rows by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import numbered


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks_from_events(events: DataFrame) -> DataFrame:
    """The tick columns, arrival_seq being their total order.

    event_type is the symbol, value the price, k of props the size. Sequence
    numbers are given per symbol before rows are dropped, so drops leave
    gaps; rows are permuted in chunks of ten, every twentieth is doubled.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    base = events.select("event_id", F.col("event_type").alias("product_id"), F.col("value").alias("price"), F.get_json_object("props", "$.k").alias("k"), ms.alias("exchange_ms"))
    base = numbered(base, ["product_id"], "event_id", "sequence").filter(F.col("event_id") % 97 != 50)
    ten = F.floor(F.col("event_id") / 10).cast("long")
    place = (ten * 10 + (F.col("event_id") * 7) % 10) * 2
    copies = F.when(F.col("event_id") % 20 == 7, F.array(place, place + 1)).otherwise(F.array(place))
    placed = numbered(base.withColumn("place", F.explode(copies)), [], "place", "arrival_seq")
    slow = F.when(F.floor(F.col("event_id") / 500).cast("long") % 4 == 3, 150).otherwise(0)
    return placed.select(
        "arrival_seq",
        "event_id",
        F.lit("ticker").alias("type"),
        "product_id",
        "price",
        F.col("k").cast("double").alias("last_size"),
        F.date_format(F.timestamp_millis("exchange_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"),
        (F.col("event_id") + 900_000_000).alias("trade_id"),
        "sequence",
        "exchange_ms",
        F.col("exchange_ms").alias("ingest_ts_ms"),
        (F.col("exchange_ms") + (F.col("event_id") * 37) % 90 + slow).alias("recv_ts_ms"),
        "k",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from_events(events_table(spark, sf_dir)).drop("k")


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival_seq, event_id, drift_kind, raw): the ticks as JSON text, with drift of six kinds injected by rule."""
    kind = F.when(F.col("event_id") % 33 == 5, F.floor(F.col("event_id") / 33).cast("long") % 6)
    rows = ticks_from_events(events_table(spark, sf_dir)).withColumn("drift_kind", kind)
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    none = F.coalesce(F.col("drift_kind"), F.lit(-1))
    price, size = F.col("price").cast("string"), F.col("k")
    pieces = [
        F.when(none != 1, F.lit('"type":"ticker",')).otherwise(""),
        F.concat(F.lit('"product_id":'), quote(F.col("product_id")), F.lit(",")),
        F.when(none.isin(0, 5), "").when(none == 2, F.concat(F.lit('"price":'), quote(price), F.lit(","))).otherwise(F.concat(F.lit('"price":'), price, F.lit(","))),
        F.when(none == 5, "").when(none == 3, F.concat(F.lit('"last_size":'), quote(size), F.lit(","))).otherwise(F.concat(F.lit('"last_size":'), size, F.lit(","))),
        F.concat(F.lit('"time":'), quote(F.col("time")), F.lit(",")),
        F.when(none == 4, F.lit('"unexpected_field":"drift_test","another_field":12345,')).otherwise(""),
        F.format_string('"trade_id":%d,"sequence":%d,"ingest_ts_ms":%d,"recv_ts_ms":%d', "trade_id", "sequence", "ingest_ts_ms", "recv_ts_ms"),
    ]
    return rows.select("arrival_seq", "event_id", F.coalesce("drift_kind", F.lit(-1)).alias("drift_kind"), F.concat(F.lit("{"), *pieces, F.lit("}")).alias("raw"))


#: The same ticks in DuckDB, as common table expressions.
TICKS_SQL = r"""
base as (
  select event_id, event_type as product_id, value as price, json_extract_string(props, '$.k') as k, epoch_us(ts) // 1000 as ms,
    row_number() over (partition by event_type order by event_id) as sequence
  from events
), placed as (
  select *, ((event_id // 10) * 10 + (event_id * 7) % 10) * 2 as place from base where event_id % 97 <> 50
), doubled as (
  select * from placed union all select * replace (place + 1 as place) from placed where event_id % 20 = 7
), ticks as (
  select row_number() over (order by place)::bigint as arrival_seq, event_id, 'ticker' as type, product_id, price, k,
    k::double as last_size, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as time, event_id + 900000000 as trade_id,
    sequence::bigint as sequence, ms as exchange_ms, ms as ingest_ts_ms,
    ms + (event_id * 37) % 90 + case when (event_id // 500) % 4 = 3 then 150 else 0 end as recv_ts_ms
  from doubled
)"""

RAW_SQL = (
    TICKS_SQL
    + r""", kinds as (
  select *, coalesce(case when event_id % 33 = 5 then (event_id // 33) % 6 end, -1) as drift_kind from ticks
), raw as (
  select arrival_seq, event_id, drift_kind, '{' || case when drift_kind <> 1 then '"type":"ticker",' else '' end
    || '"product_id":"' || product_id || '",'
    || case when drift_kind in (0, 5) then '' when drift_kind = 2 then '"price":"' || price::varchar || '",' else '"price":' || price::varchar || ',' end
    || case when drift_kind = 5 then '' when drift_kind = 3 then '"last_size":"' || k || '",' else '"last_size":' || k || ',' end
    || '"time":"' || time || '",' || case when drift_kind = 4 then '"unexpected_field":"drift_test","another_field":12345,' else '' end
    || '"trade_id":' || trade_id || ',"sequence":' || sequence || ',"ingest_ts_ms":' || ingest_ts_ms || ',"recv_ts_ms":' || recv_ts_ms || '}' as raw
  from kinds
)"""
)
