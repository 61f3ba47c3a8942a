"""Prices, volatility, volume and throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import DEFAULTS, YEAR_SECONDS, EngineConfig
from ..functions.ordering import last_rows, sliding_sum
from ..functions.scalars import money, number, ratio, symbol
from .ingest import for_volatility, for_volume, for_vwap


def _newest(df: DataFrame, rows: int) -> DataFrame:
    """The last `rows` rows of each symbol; the limit is applied before the shuffle as well."""
    newest = Window.partitionBy("product_id").orderBy(F.desc("arrival_seq"))
    return df.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= rows)


def _priced(ticks: DataFrame) -> DataFrame:
    amount = money(number(F.col("price"))) * money(number(F.col("last_size")))
    return for_vwap(ticks).withColumns({"product_id": symbol(F.col("product_id")), "__pv": amount, "__v": money(number(F.col("last_size")))})


def _vwap(value: Column, volume: Column) -> Column:
    return ratio(value.cast("double"), volume.cast("double"))


def vwap_rolling(ticks: DataFrame, config: EngineConfig = DEFAULTS, carry: Sequence[str] = ()) -> DataFrame:
    """Per tick the volume-weighted price of its symbol's last rows; 0 where they have no volume. Columns to carry along come last."""
    n = config.vwap_window
    priced = _priced(ticks).select("arrival_seq", "product_id", "__pv", "__v", *carry)
    summed = last_rows(priced, ["product_id"], "arrival_seq", n, {"__spv": sliding_sum(F.col("__pv"), n), "__sv": sliding_sum(F.col("__v"), n)})
    return summed.select("arrival_seq", "product_id", _vwap(F.col("__spv"), F.col("__sv")).alias("vwap"), F.least(F.col("__n"), F.lit(n)).alias("window_rows"), *carry)


def vwap_snapshot(ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The latest volume-weighted price of each symbol, from its last rows only."""
    rows = _newest(_priced(ticks).select("arrival_seq", "product_id", "__pv", "__v"), config.vwap_window)
    summed = rows.groupBy("product_id").agg(F.sum("__pv").alias("pv"), F.sum("__v").alias("v"), F.count(F.lit(1)).alias("window_rows"))
    return summed.select("product_id", _vwap(F.col("pv"), F.col("v")).alias("vwap"), "window_rows").orderBy("product_id")


def log_returns(ticks: DataFrame) -> DataFrame:
    """Per tick but each symbol's first the log of its price over the one before."""
    prices = for_volatility(ticks).select("arrival_seq", symbol(F.col("product_id")).alias("product_id"), number(F.col("price")).alias("price"))
    rows = last_rows(prices, ["product_id"], "arrival_seq", 1, {"__p": lambda w: F.lag("price").over(w)})
    return rows.filter("__p is not null").select("arrival_seq", "product_id", F.log(F.col("price") / F.col("__p")).alias("log_return"))


def volatility(ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Annualised volatility in percent of each symbol with enough returns among its last."""
    prices = for_volatility(ticks).select("arrival_seq", symbol(F.col("product_id")).alias("product_id"), number(F.col("price")).alias("price"))
    recent = _newest(prices, config.volatility_window + 1)
    last = F.lag("price").over(Window.partitionBy("product_id").orderBy("arrival_seq"))
    returns = recent.withColumn("r", F.log(F.col("price") / last)).filter("r is not null")
    found = returns.groupBy("product_id").agg(F.count("r").alias("n_returns"), F.avg("r").alias("mean_return"), F.stddev_pop("r").alias("sd"))
    annual = F.col("sd") * F.sqrt(F.lit(float(YEAR_SECONDS))) * 100
    return found.filter(F.col("n_returns") >= config.volatility_least).select("product_id", "n_returns", F.round("mean_return", 8).alias("mean_return"), F.round(annual, 4).alias("volatility_pct"))


def _last_of_step(rows: DataFrame, step_ms: int, columns: Sequence[str]) -> DataFrame:
    """The newest row of each symbol and step of receipt; at_ms is the step's end."""
    at = F.floor(F.col("recv_ts_ms") / step_ms).cast("long") * step_ms + step_ms
    newest = F.max_by(F.struct(*columns), "arrival_seq").alias("r")
    return rows.groupBy(at.alias("at_ms"), "product_id").agg(newest).select("at_ms", "product_id", *[f"r.{c}" for c in columns])


def vwap_periodic(ticks: DataFrame, step_ms: int = 5_000, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(at_ms, product_id, vwap, window_rows): the rolling price as it stood at the end of each step in which the symbol had ticks."""
    return _last_of_step(vwap_rolling(ticks, config, ["recv_ts_ms"]), step_ms, ["vwap", "window_rows"])


def volatility_periodic(ticks: DataFrame, step_ms: int = 10_000, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(at_ms, product_id, n_returns, volatility_pct) at the end of each step, over the symbol's last returns by then.

    Returns are summed as decimals of 16 places, so that sliding sums are exact.
    """
    n = config.volatility_window
    prices = for_volatility(ticks).select("arrival_seq", "recv_ts_ms", symbol(F.col("product_id")).alias("product_id"), number(F.col("price")).alias("price"))
    before = last_rows(prices, ["product_id"], "arrival_seq", 1, {"__p": lambda w: F.lag("price").over(w)}).drop("__n")
    r = F.log(F.col("price") / F.col("__p"))
    returns = before.filter("__p is not null").withColumns({"__r": r.cast("decimal(20,16)"), "__r2": (r * r).cast("decimal(22,16)")})
    summed = last_rows(returns, ["product_id"], "arrival_seq", n, {"__s": sliding_sum(F.col("__r"), n), "__s2": sliding_sum(F.col("__r2"), n)})
    held = F.least(F.col("__n"), F.lit(n))
    mean = F.col("__s").cast("double") / held
    variance = F.greatest(F.lit(0.0), F.col("__s2").cast("double") / held - mean * mean)
    percent = F.round(F.sqrt(variance) * F.sqrt(F.lit(float(YEAR_SECONDS))) * 100, 4)
    found = summed.withColumns({"n_returns": held.cast("long"), "volatility_pct": percent})
    return _last_of_step(found, step_ms, ["n_returns", "volatility_pct"]).filter(F.col("n_returns") >= config.volatility_least)


def volume(ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Traded value and trades per symbol and window of receipt."""
    ms = config.volume_window_ms
    amount = money(number(F.col("price"))) * money(number(F.col("last_size")))
    start = F.floor(F.col("recv_ts_ms") / ms).cast("long") * ms
    sums = for_volume(ticks).groupBy(start.alias("window_start_ms"), symbol(F.col("product_id")).alias("product_id")).agg(F.sum(amount).cast("double").alias("volume"), F.count(F.lit(1)).alias("trades"))
    return sums.withColumn("volume_per_minute", F.col("volume") / (ms / 1000.0) * 60.0)


def health(ticks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Events per second, and the last price, per window of receipt; all events count."""
    ms = config.health_window_ms
    start = F.floor(F.col("recv_ts_ms") / ms).cast("long") * ms
    price = number(F.col("price"))
    sums = ticks.groupBy(start.alias("window_start_ms")).agg(F.count(F.lit(1)).alias("events"), F.max_by(price, F.when(price.isNotNull(), F.col("arrival_seq"))).alias("last_price"))
    return sums.withColumn("events_per_second", F.col("events") / (ms / 1000.0))


def last_price(ticks: DataFrame) -> DataFrame:
    """The last price of any symbol that is a number."""
    price = number(F.col("price"))
    return ticks.agg(F.max_by(price, F.when(price.isNotNull(), F.col("arrival_seq"))).alias("last_price"))
