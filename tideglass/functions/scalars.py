"""Column functions: clocks, latencies, casts, frames, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_ms(time: Column) -> Column:
    """Epoch milliseconds (truncated) of an ISO-8601 text; null where it is none. Times without zone are UTC."""
    return F.unix_millis(F.try_to_timestamp(time))


def once(value: Column) -> Column:
    """A dear value as a generated column: the optimizer does not repeat it in each of the expressions and filters that use it."""
    return F.explode(F.array(value))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def number(value: Column) -> Column:
    """The value as a double; null where it is none."""
    return value.try_cast("double")


def symbol(product_id: Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(product_id, F.lit(default))


def raw_latency(ingest: Column, recv: Column) -> Column:
    """recv - ingest where both are set and not 0, else null; may be negative."""
    return F.when((ingest != 0) & (recv != 0), recv - ingest)


def clamped_latency(ingest: Column, recv: Column) -> Column:
    """As raw_latency, negatives as 0 (the detector's and the consumers' rule)."""
    return F.when((ingest != 0) & (recv != 0), F.greatest(F.lit(0), recv - ingest))


def report_latency(ingest: Column, recv: Column) -> Column:
    """As raw_latency, negatives dropped (the histogram's and the report's rule)."""
    latency = raw_latency(ingest, recv)
    return F.when(latency >= 0, latency)


def age_ms(ingest: Column, asof: Column) -> Column:
    return F.greatest(F.lit(0), asof - ingest)


def pipe_ms(recv: Column, asof: Column) -> Column:
    """Time since receipt; null where there is none."""
    return F.when(recv > 0, F.greatest(F.lit(0), asof - recv))


def money(value: Column) -> Column:
    """Exact decimal, so sums do not depend on their order; null for what is no number of at most ten digits before the point."""
    return value.try_cast("decimal(18,8)")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def framed(payload: Column) -> Column:
    """A payload with its 4-byte big-endian length before it."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(payload)), 8, "0")), payload)


# indices into n sorted values; each is a definition of its own
def index_nearest(p: float) -> Column:
    """round-half-even(p/100 * (n-1))"""
    return F.rint(F.lit(p / 100) * (F.col("n") - 1)).cast("long")


def index_floor(p: int) -> Column:
    """int(n * p/100), in whole numbers"""
    return F.floor(F.col("n") * p / 100).cast("long")


def index_capped(p: int) -> Column:
    """int(n * p/100), the last value at most"""
    return F.least(index_floor(p), F.col("n") - 1)
