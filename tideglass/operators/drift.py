"""Schema drift, judged on the raw JSON: typed readers would lose the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import OPTIONAL_KEYS, REQUIRED_KEYS
from ..functions.scalars import once

TEXT, NUMBER, WHOLE = "text", "number", "whole"
#: What each key must hold; true and false pass for numbers.
EXPECTED = {"type": TEXT, "product_id": TEXT, "price": NUMBER, "last_size": NUMBER, "time": TEXT, "ingest_ts_ms": WHOLE}


def _fits(kind: Column, expected: str) -> Column:
    if expected == TEXT:
        return kind == "STRING"
    whole = kind.isin("BIGINT", "BOOLEAN")
    return whole if expected == WHOLE else whole | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")


def _sorted(keys: Column) -> Column:
    return F.array_join(F.array_sort(keys), ",")


def check_drift(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds missing_keys, type_mismatches, unexpected_keys (sorted, comma-joined) and is_drift.

    Unexpected keys are told but are no drift. A whole number beyond 64 bits
    counts as a fraction. Text that is no JSON object misses every key.
    """
    keys = F.coalesce(F.json_object_keys(F.col(raw)), F.array().cast("array<string>"))
    literal = lambda names: F.array(*[F.lit(n) for n in names])
    v = F.try_parse_json(F.col(raw))
    wrong = []
    for key, expected in EXPECTED.items():
        kind = F.schema_of_variant(F.try_variant_get("__v", f"$.{key}", "variant"))
        wrong.append(F.when(F.array_contains("__keys", key) & ~F.coalesce(_fits(kind, expected), F.lit(False)), F.lit(key)))
    judged = df.withColumn("__keys", once(keys)).withColumn("__v", once(v)).withColumns(
        {
            "missing_keys": _sorted(F.array_except(literal(REQUIRED_KEYS), F.col("__keys"))),
            "type_mismatches": _sorted(F.array_compact(F.array(*wrong))),
            "unexpected_keys": _sorted(F.array_except(F.col("__keys"), literal(REQUIRED_KEYS + OPTIONAL_KEYS))),
        }
    )
    return judged.withColumn("is_drift", (F.col("missing_keys") != "") | (F.col("type_mismatches") != "")).drop("__keys", "__v")


def drift_samples(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The samples that the drift log keeps."""
    return check_drift(df, raw).filter("is_drift")
