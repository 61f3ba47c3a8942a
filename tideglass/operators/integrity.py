"""Duplicates, out-of-order events and sequence gaps per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import ANOMALY_LABELS
from ..functions.ordering import Running, numbered, running
from ..functions.scalars import iso_ms, symbol


def flags(ticks: DataFrame) -> DataFrame:
    """Adds is_duplicate, is_out_of_order and is_gap.

    A duplicate's (symbol, trade_id) came before; a null id is none. Out of
    order is a time under the symbol's largest so far (equal, or unreadable,
    is not). A gap is a sequence more than one above the symbol's last,
    whichever way that went.
    """
    rows = ticks.withColumns({"__s": symbol(F.col("product_id"), "unknown"), "__t": iso_ms(F.col("time"))})
    rows = running(rows, ["__s"], "arrival_seq", {"__max": Running("max", F.col("__t"), False), "__seq": Running("last", F.col("sequence"), False)})
    first = F.row_number().over(Window.partitionBy("__s", "trade_id").orderBy("arrival_seq"))
    no = F.lit(False)
    # rows without an id are kept out of the window: they would be one group
    with_id = rows.filter("trade_id is not null").withColumn("is_duplicate", first > 1)
    rows = with_id.unionByName(rows.filter("trade_id is null").withColumn("is_duplicate", no))
    return rows.withColumns(
        {
            "is_out_of_order": F.coalesce((F.col("__max") > 0) & (F.col("__t") < F.col("__max")), no),
            "is_gap": F.coalesce(F.col("sequence") > F.col("__seq") + 1, no),
        }
    ).drop("__s", "__t", "__max", "__seq")


def lru_duplicates(ticks: DataFrame, ids: int) -> DataFrame:
    """arrival_seq of duplicates when only the `ids` last touched trade_ids of a symbol are remembered.

    An id is still remembered iff fewer than `ids` other ids were touched
    since. Between two touches lie at most that many rows, so most cases are
    settled by the distance; for the others, rows in between that are
    touched again in between (nested pairs) are taken off the distance.
    """
    rows = ticks.filter("trade_id is not null").select("arrival_seq", symbol(F.col("product_id"), "unknown").alias("s"), "trade_id")
    rows = numbered(rows, ["s"], "arrival_seq", "i")
    before = F.lag("i").over(Window.partitionBy("s", "trade_id").orderBy("i"))
    pairs = rows.withColumn("p", before).filter("p is not null").withColumn("between", F.col("i") - F.col("p") - 1)
    near, far = pairs.filter(F.col("between") < ids), pairs.filter(F.col("between") >= ids)
    inner = pairs.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("i").alias("i2"))
    nested = (F.col("s") == F.col("s2")) & (F.col("p2") > F.col("p")) & (F.col("i2") < F.col("i"))
    counted = far.join(inner, nested, "left").groupBy("arrival_seq", "between").agg(F.count("p2").alias("again"))
    settled = counted.filter(F.col("between") - F.col("again") < ids).select("arrival_seq")
    return near.select("arrival_seq").union(settled)


def counters(flagged: DataFrame) -> DataFrame:
    """Totals of a flagged frame; is_drift, is_spike and is_incident are counted where there."""
    total = lambda c: F.count_if(F.col(c)) if c in flagged.columns else F.lit(0).cast("long")
    return flagged.agg(
        F.count(F.lit(1)).alias("processed"),
        *[F.coalesce(total(c), F.lit(0)).alias(n) for c, n in (("is_drift", "drift"), ("is_duplicate", "duplicates"), ("is_out_of_order", "out_of_order"), ("is_gap", "gaps"), ("is_spike", "spikes"), ("is_incident", "incidents"))],
    )


def anomalies_by_type(counted: DataFrame) -> DataFrame:
    """(type, total) with the exported labels; unknown names are left out."""
    names = {"drift": "drift", "duplicates": "duplicate", "out_of_order": "ooo", "gaps": "gap", "spikes": "latency_spike"}
    pairs = F.array(*[F.struct(F.lit(ANOMALY_LABELS[label]).alias("type"), F.col(c).alias("total")) for c, label in names.items() if label in ANOMALY_LABELS])
    return counted.select(F.explode(pairs).alias("a")).select("a.type", "a.total")
