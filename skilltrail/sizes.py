"""Measured size of join sides that may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Far below what an executor can hold once per JVM, far above a dictionary of skills.
BROADCAST_BYTES = 64 << 20


def measured_bytes(df: DataFrame) -> int:
    """Rough in-memory size of a small table: text lengths plus a row overhead."""
    text = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    fixed = 16 + 8 * len(df.columns)
    row = sum((F.coalesce(t, F.lit(0)) for t in text), F.lit(fixed))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("b")).first()["b"]
