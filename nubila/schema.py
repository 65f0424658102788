"""Column roles and checks of point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = ("point_id", "batch", "x", "y", "z")
#: Cells per axis that 16-bit keys can tell apart, and batches.
SPAN, BATCHES = 1 << 16, 1 << 15


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail at once if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def checked_grid(df: DataFrame, axes=("gx", "gy", "gz"), batch: str = "batch") -> DataFrame:
    """Fail while running if a cell or batch doesn't fit its bits; keys would wrap around."""
    ok = (F.col(batch) >= 0) & (F.col(batch) < BATCHES)
    for a in axes:
        ok = ok & (F.col(a) >= 0) & (F.col(a) < SPAN)
    return df.withColumn(batch, F.when(ok, F.col(batch)).otherwise(F.raise_error(F.lit("cell or batch outside the key's range")).cast("int")))
