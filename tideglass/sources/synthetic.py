"""Synthetic ticks: any number of them, the same on every run and any number of tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chaos import draw

#: Base price of each symbol (fixed values of the generator), and of any other.
BASE_PRICES = {"BTC-USD": 95_000.0, "ETH-USD": 3_500.0, "SOL-USD": 200.0}
OTHER_PRICE = 100.0


def synthetic_ticks(spark: SparkSession, rows: int, seed: int = 0, symbols: tuple[str, ...] = tuple(BASE_PRICES), start_ms: int = 1_735_689_600_000, per_second: float = 1_000.0) -> DataFrame:
    """Prices normal around the symbol's base, sizes exponential; sequence runs over all symbols together.

    trade_id counts from 900,000,000. Times advance at per_second.
    """
    ids = spark.range(rows).withColumnRenamed("id", "seq")
    named = ids.withColumn("product_id", F.element_at(F.array(*[F.lit(s) for s in symbols]), (F.floor(draw(seed, 1, "seq") * len(symbols)) + 1).cast("int")))
    base = F.lit(OTHER_PRICE)
    for name, price in BASE_PRICES.items():
        base = F.when(F.col("product_id") == name, price).otherwise(base)
    # two even draws make a normal one (Box and Muller)
    normal = F.sqrt(-2 * F.log(1 - draw(seed, 2, "seq"))) * F.cos(draw(seed, 3, "seq") * (2 * math.pi))
    ms = F.lit(start_ms) + F.floor(F.col("seq") * (1000.0 / per_second)).cast("long")
    return named.select(
        (F.col("seq") + 1).alias("arrival_seq"),
        F.lit("ticker").alias("type"),
        "product_id",
        F.bround(base * (1 + normal * 0.001), 2).alias("price"),
        F.bround(-F.log(1 - draw(seed, 4, "seq")) * 0.1, 8).alias("last_size"),
        F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'.000000Z'").alias("time"),
        (F.col("seq") + 900_000_000).alias("trade_id"),
        F.col("seq").alias("sequence"),
        ms.alias("ingest_ts_ms"),
    )
