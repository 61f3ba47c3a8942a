"""Decoding, validation and stamping of incoming events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import money, now_ms, number, once

#: Columns of a validated tick.
MODEL = ("type", "product_id", "price", "last_size", "time", "trade_id")


def decode(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(objects with column v: variant, rejects): text that is no JSON object is set aside, never an error."""
    parsed = df.withColumn("v", once(F.try_parse_json(F.col(raw))))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return parsed.filter(is_object), parsed.filter(~is_object).drop("v")


def only_type(df: DataFrame, kind: str = "ticker") -> DataFrame:
    return df.filter(F.col("type") == kind)


def only_symbols(df: DataFrame, symbols: list[str]) -> DataFrame:
    """What a subscription to these symbols would deliver."""
    return df.filter(F.col("product_id").isin(symbols))


def fields(objects: DataFrame) -> DataFrame:
    """The known fields of decoded objects as text, plus which keys there are."""
    names = ["type", "product_id", "price", "last_size", "time", "trade_id", "sequence", "ingest_ts_ms", "recv_ts_ms"]
    return objects.select(*[c for c in objects.columns if c != "v"], *[F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in names])


def validate(df: DataFrame) -> DataFrame:
    """Coerces to the model and drops rows that do not fit: numbers may come as text, the size defaults to 0, the id to null.

    A trade_id that is given but is no whole number does not fit.
    """
    price, size, trade = number(F.col("price")), number(F.col("last_size")), F.col("trade_id").try_cast("long")
    fits = F.col("type").isNotNull() & F.col("product_id").isNotNull() & price.isNotNull() & F.col("time").isNotNull()
    fits = fits & (F.col("last_size").isNull() | size.isNotNull()) & (F.col("trade_id").isNull() | trade.isNotNull())
    return df.filter(fits).withColumns({"price": price, "last_size": F.coalesce(size, F.lit(0.0)), "trade_id": trade})


def prune(df: DataFrame, *more: str) -> DataFrame:
    """The model's columns and the named others."""
    return df.select(*more, *[c for c in MODEL if c not in more])


def stamp_ingest(df: DataFrame, at=None) -> DataFrame:
    return df.withColumn("ingest_ts_ms", now_ms() if at is None else at)


def stamp_receipt(df: DataFrame, raw: str = "raw", at=None) -> DataFrame:
    """Sets recv_ts_ms where the event has no such key; a null that it has stays."""
    has = F.coalesce(F.array_contains(F.json_object_keys(F.col(raw)), "recv_ts_ms"), F.lit(False))
    return df.withColumn("recv_ts_ms", F.when(has, F.col("recv_ts_ms").try_cast("long")).otherwise(now_ms() if at is None else at))


# each analysis takes its own rows; the differences in strictness are meant
def _summable() -> Column:
    """Whether price and size can be summed exactly: NaN, infinities and numbers of over ten digits can not, and are in no sum."""
    return money(number(F.col("price"))).isNotNull() & money(number(F.col("last_size"))).isNotNull()


def for_vwap(df: DataFrame) -> DataFrame:
    return df.filter((number(F.col("price")) > 0) & (number(F.col("last_size")) >= 0) & (F.col("ingest_ts_ms") > 0) & _summable())


def for_volatility(df: DataFrame) -> DataFrame:
    price = number(F.col("price"))
    return df.filter((price > 0) & (price < float("inf")))


def for_volume(df: DataFrame) -> DataFrame:
    return df.filter((number(F.col("price")) > 0) & (number(F.col("last_size")) > 0) & _summable())
