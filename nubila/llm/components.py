"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every node that an edge (a, b) touches; component is the least node reachable.

    Each round is a pre-aggregated minimum and a join, so a node with very many neighbours stays spread.
    """
    now = ws.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        star = ws.save(_small_star(_large_star(now)).distinct(), "star")
        ws.drop(now)
        now = star
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30))).alias("s")).first()
        if seen == mark:
            break
        mark = seen
    # a forest of stars: every edge goes from a node to its root
    nodes = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
