"""Point tables and records derived from the shared relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_points(spark: SparkSession, sf_dir: str, batch_by_label: bool = False) -> DataFrame:
    """One cloud from the first three components of each vector; with batch_by_label one cloud per label."""
    e = table(spark, sf_dir, "embeddings")
    xyz = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("point_id"), (F.col("label") if batch_by_label else F.lit(0)).cast("int").alias("batch"), *xyz, F.col("label").cast("int").alias("label"), F.col("embedding")[3].cast("double").alias("f0"), F.col("embedding")[4].cast("double").alias("f1"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud per event type: value, time of day and day of month as coordinates."""
    kinds = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")) - 1
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("point_id"), kinds.cast("int").alias("batch"), (F.col("value") / 10).alias("x"),
        (F.hour("ts") + F.minute("ts") / 60).cast("double").alias("y"), (F.dayofmonth("ts") - 1).cast("double").alias("z"),
    )


def bench_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings of methods by room, mode and k."""
    ks = F.array(*map(F.lit, (8, 16, 24, 32, 48, 64)))
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"), F.col("user_id").alias("room"), F.col("event_type").alias("method"), F.when(F.col("event_id") % 2 == 0, "pre").otherwise("post").alias("mode"),
        F.element_at(ks, (F.col("event_id") % 6 + 1).cast("int")).cast("int").alias("k"), (F.col("value") / 4).alias("construction_ms"), F.col("value").alias("query_ms"),
    )
