"""Pooling into cells, unpooling, and conversions between batch columns and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import CELL, with_cells


def grid_pool(points: DataFrame, size: float, features: tuple[str, ...] = (), shift: float = 0.0) -> DataFrame:
    """Per voxel the mean coordinates, the largest features, the number of points and a dense cluster id within its batch."""
    pooled = with_cells(points, size, shift).groupBy(*CELL).agg(*[F.avg(a).alias(a) for a in "xyz"], *[F.max(f).alias(f) for f in features], F.count("*").alias("cnt"))
    return pooled.withColumn("cluster", F.dense_rank().over(Window.partitionBy("batch").orderBy("gx", "gy", "gz")).cast("long"))


def unpool(points: DataFrame, pooled: DataFrame, size: float, features: tuple[str, ...], shift: float = 0.0, add: tuple[str, ...] = ()) -> DataFrame:
    """Each point with the features of its cluster, plus its own columns in add."""
    p = pooled.select(*CELL, "cluster", *[F.col(f).alias(f"p_{f}") for f in features])
    out = with_cells(points, size, shift).join(p, list(CELL))
    extra = lambda f: F.col(f"p_{f}") + F.col(f) if f in add else F.col(f"p_{f}")
    return out.select("point_id", "batch", "cluster", *[extra(f).alias(f"up_{f}") for f in features])


def serialized_pool(coded: DataFrame, depth: int, features: tuple[str, ...], reduce: str = "max") -> DataFrame:
    """Group codes that agree above 3*depth bits; the first point in code order stands for the group."""
    fn = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}[reduce]
    return coded.groupBy(F.shiftright("code", 3 * depth).alias("pool")).agg(F.min_by("point_id", F.struct("code", "point_id")).alias("head"), F.count("*").alias("cnt"), *[fn(f).alias(f) for f in features])


def serialized_unpool(coded: DataFrame, pooled: DataFrame, depth: int, features: tuple[str, ...], add: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, features): each point's features of its group in serialized_pool()'s result, plus its own columns in add."""
    own = coded.select("point_id", F.shiftright("code", 3 * depth).alias("pool"), *[F.col(f).alias(f"__{f}") for f in add])
    return own.join(pooled.select("pool", *features), "pool").select("point_id", *[(F.col(f) + F.col(f"__{f}") if f in add else F.col(f)).alias(f) for f in features])


def batch_offsets(points: DataFrame) -> DataFrame:
    """(batch, count, offset): inclusive prefix sums over batches; batches are few, points are counted first."""
    counts = points.groupBy("batch").agg(F.count("*").alias("cnt"))
    return counts.withColumn("offset", F.sum("cnt").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)))


def offsets_to_batch(offsets: DataFrame) -> DataFrame:
    """(batch, row) for each row that the offsets stand for."""
    return offsets.select("batch", F.explode(F.sequence(F.col("offset") - F.col("cnt"), F.col("offset") - 1)).alias("row"))


def batch_mean(points: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return points.groupBy("batch").agg(*[F.avg(c).alias(c) for c in columns])
