"""k-nearest-neighbour joins: grid candidates, certified exact search, padding, adaptive cells and inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import Search, nearest
from .cells import exploded, octree_select, with_cells

P = ("px", "py", "pz")


def square(metric: str = "l2") -> Column:
    """Squared Euclidean (l2) or Manhattan (l1) distance of q* and s* columns, always in this order of operations."""
    d = [F.col(f"q{a}") - F.col(f"s{a}") for a in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] if metric == "l2" else F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2])


def sides(queries: DataFrame, support: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    q = queries.select(F.col("point_id").alias("query_id"), "batch", *[F.col(a).alias(f"q{a}") for a in "xyz"], *extra)
    s = support.select(F.col("point_id").alias("support_id"), "batch", *[F.col(a).alias(f"s{a}") for a in "xyz"], *extra)
    return q, s


def top(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest by (distance, id); Spark limits each group before the exchange too."""
    w = Window.partitionBy("query_id").orderBy("d2", "support_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "support_id", "d2")


def candidates(queries: DataFrame, support: DataFrame, edge: float, shift: float = 0.0, metric: str = "l2") -> DataFrame:
    """Pairs within the 27 cells of that edge around each query: an equi-join on cells."""
    q, s = sides(with_cells(queries, edge, shift, P), with_cells(support, edge, shift, P), P)
    return exploded(q, P).join(s, ["batch", *P]).withColumn("d2", square(metric)).select("query_id", "support_id", "d2")


def knn_grid(points: DataFrame, k: int, voxel: float, *, num_down: int = 2, queries: DataFrame | None = None, cut_radius: float | None = None, shift: float = 0.0, cell_cap: int | None = None) -> DataFrame:
    """The k nearest among the points of the 27 search cells around a query; a search cell is 2**num_down voxels wide.

    Approximate: a nearer point two cells away is missed.  cut_radius keeps distances strictly below it; cell_cap keeps at most
    so many points of a voxel (a modelled limit of fixed-size grids, by id).
    """
    if cell_cap is not None:
        w = Window.partitionBy("batch", "gx", "gy", "gz").orderBy("point_id")
        support = with_cells(points, voxel, shift).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cell_cap)
        points, queries = support.drop("__rn", "gx", "gy", "gz"), points if queries is None else queries
    return nearest(points, Search(k, cells=(float(voxel), float(shift), num_down), cut=None if cut_radius is None else float(cut_radius) ** 2), queries)


def knn_back(fine: DataFrame, coarse: DataFrame, k: int, cell: float, shift: float = 0.0) -> DataFrame:
    """For every fine point its k nearest coarse points among 27 cells; points without any are left out."""
    return nearest(coarse, Search(k, cells=(float(cell), float(shift), 0)), fine)


def padded(found: DataFrame, queries: DataFrame, k: int, pad: str) -> DataFrame:
    """Exactly k rows per query; is_padding marks the rows that are made up.

    pad: self (the query's own id, infinite distance), minus_one (-1, 1e10), nearest (the first neighbour repeated) or none.
    """
    if pad == "none":
        return found.withColumn("is_padding", F.lit(False))
    slots = queries.select(F.col("point_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank"))
    out = slots.join(found, ["query_id", "rank"], "left").withColumn("is_padding", F.col("support_id").isNull())
    if pad == "self":
        fill = F.col("query_id"), F.lit(float("inf"))
    elif pad == "minus_one":
        fill = F.lit(-1).cast("long"), F.lit(1e10)
    elif pad == "nearest":
        w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        fill = F.first("support_id", ignorenulls=True).over(w), F.first("d2", ignorenulls=True).over(w)
    else:
        raise ValueError(f"unknown padding {pad!r}")
    return out.select("query_id", "rank", F.coalesce("support_id", fill[0]).alias("support_id"), F.coalesce("d2", fill[1]).alias("d2"), "is_padding")


def starting_edge(points: DataFrame, k: int) -> tuple[float, float]:
    """(edge, extent): an edge that gives about k points to a cell if they were spread evenly."""
    r = points.agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in "xyz"]).first()
    extent = max(r.x or 0.0, r.y or 0.0, r.z or 0.0)
    if not r.n or extent == 0:
        return 1.0, 0.0
    volume = 1.0
    for side in (r.x, r.y, r.z):
        volume *= max(side, extent / 1000)
    return max((volume * k / r.n) ** (1 / 3), extent / 60000), extent


def knn_exact(points: DataFrame, k: int, *, queries: DataFrame | None = None, metric: str = "l2", rounds: bool = False) -> DataFrame:
    """The k nearest points of each query's batch, without a cross join; with ``rounds`` by knn_rounds()."""
    return knn_rounds(points, k, queries=queries, metric=metric) if rounds else nearest(points, Search(k, metric), queries)


def knn_rounds(points: DataFrame, k: int, *, queries: DataFrame | None = None, metric: str = "l2") -> DataFrame:
    """The k nearest points by growing cells, with the round in which each query was finished.

    A query is finished when its k-th distance is no more than its distance to the edge of its 27 cells; the others go on
    with cells twice as wide, at last with cells as wide as the cloud.  Each round's rest is checkpointed.
    """
    queries = queries if queries is not None else points
    edge, extent = starting_edge(points, k)
    left, done, step = queries, None, 0
    while True:
        step += 1
        last = edge > extent
        found = top(candidates(left, points, edge, metric=metric), k)
        if last:
            sure = found
        else:
            room = [F.col(a) - F.floor(F.col(a) / edge) * edge for a in "xyz"]
            safe = F.least(*room, *[F.lit(edge) - r for r in room]) + edge
            limit = left.select(F.col("point_id").alias("query_id"), (safe * safe if metric == "l2" else safe).alias("__safe"))
            # strictly nearer, so that ties at the edge are settled by ids later
            ready = found.where(F.col("rank") == k).join(limit, "query_id").where(F.col("d2") < F.col("__safe")).select("query_id")
            both = checkpointed(found.join(ready, "query_id"))
            sure = both
            left = checkpointed(left.join(both.select(F.col("query_id").alias("point_id")).distinct(), "point_id", "left_anti"))
        sure = sure.withColumn("round", F.lit(step))
        done = sure if done is None else done.unionByName(sure)
        if last or left.isEmpty():
            return done
        edge *= 2


def knn_adaptive(points: DataFrame, k: int, size: float, levels: int, *, low: int = 2, high: int = 8, shift: float = 0.0) -> DataFrame:
    """Grid kNN in which each query searches cells of the octree level that octree_select() gives it."""
    level = checkpointed(octree_select(points, size, levels, k, low, high, shift).select("point_id", "level"))
    # one search for each level that some query uses, levels + 1 at most
    used = sorted(r[0] for r in level.select("level").distinct().collect())
    out = None
    for v in used or [0]:
        asked = points.join(level.where(F.col("level") == v).select("point_id"), "point_id", "left_semi")
        found = nearest(points, Search(k, cells=(float(size), float(shift), v)), asked)
        out = found if out is None else out.unionByName(found)
    return out


def trained_centres(points: DataFrame, lists: int = 16, seed: int = 1) -> np.ndarray:
    """k-means centres of the points; no more lists than leave 39 points to each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    most = max(1, points.count() // 39)
    lists = lists if lists <= most else 1 << (most.bit_length() - 1)
    vectors = VectorAssembler(inputCols=["x", "y", "z"], outputCol="v").transform(points)
    return np.array(KMeans(k=lists, seed=seed, featuresCol="v", predictionCol="list").fit(vectors).clusterCenters())


def _to_centres(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = [p[:, i, None] - centres[None, :, i] for i in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _nearest_lists(centres: np.ndarray, probe: int):
    """Each row once for each of its ``probe`` nearest centres, with the centre's number: the smaller one among equally near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                p = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 5)], axis=1)
                order = np.argsort(_to_centres(p, centres), axis=1, kind="stable")[:, :probe]
                take = pa.array(np.repeat(np.arange(len(p)), order.shape[1]))
                yield pa.RecordBatch.from_arrays([*[c.take(take) for c in part.columns], pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(p)))], ["id", "batch", "x", "y", "z", "list", "nth"])

    return run


def in_lists(points: DataFrame, centres: np.ndarray, probe: int = 1) -> DataFrame:
    """(id, batch, x, y, z, list, nth): points with their nearest lists, nth counting from 1."""
    row = points.select(F.col("point_id").cast("long").alias("id"), F.col("batch").cast("int").alias("batch"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    return row.mapInArrow(_nearest_lists(centres, min(probe, len(centres))), "id long, batch int, x double, y double, z double, list int, nth int")


def knn_ivf(points: DataFrame, k: int, lists: int = 16, probe: int = 4, seed: int = 1, centres: np.ndarray | None = None) -> DataFrame:
    """Approximate kNN over inverted lists: k-means centres, each query looks into its nearest ``probe`` lists."""
    centres = trained_centres(points, lists, seed) if centres is None else centres
    lists = len(centres)
    # a list of a batch is a cloud of its own; a query has its neighbours of each list that it looks into
    at = lambda probe: in_lists(points, centres, probe).select(F.col("id").alias("point_id"), (F.col("batch").cast("long") * lists + F.col("list")).alias("batch"), "x", "y", "z")
    return top(nearest(at(1), Search(k), at(probe)), k)


#: The numbers of lists that calibration tries.
PROBES = (*range(1, 17), 24, 32, 48, 64)


def _list_ranks(centres: np.ndarray):
    """How many lists a query must look into to see the row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                d = _to_centres(np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4)], axis=1), centres)
                own = part.column(4).to_numpy(zero_copy_only=False)
                mine = d[np.arange(len(d)), own][:, None]
                need = ((d < mine) | ((d == mine) & (np.arange(d.shape[1]) < own[:, None]))).sum(1) + 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(need.astype(np.int32))], ["query_id", "need"])

    return run


def ivf_recall(points: DataFrame, exact: DataFrame, centres: np.ndarray, k: int, probes: tuple[int, ...] = PROBES) -> DataFrame:
    """(nprobe, mean_recall, min_recall) of kNN over inverted lists for all ``probes`` at once.

    A true neighbour is found as soon as its list is looked into, since nothing nearer can push it out.  So the number of lists
    that each true neighbour needs gives the recall of every number of lists, without a search for each.
    """
    probes = tuple(p for p in probes if p <= len(centres)) or (1,)
    home = in_lists(points, centres).select(F.col("id").alias("support_id"), "list")
    q = points.select(F.col("point_id").alias("query_id"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    true = exact.where(F.col("rank") <= k).select("query_id", "support_id").join(home, "support_id").join(q, "query_id").select("query_id", "x", "y", "z", "list")
    need = true.mapInArrow(_list_ranks(centres), "query_id long, need int")
    each = need.groupBy("query_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("need") <= p).alias(f"p{p}") for p in probes])
    share = lambda p: F.col(f"p{p}") / F.col("n")
    one = each.agg(*[f(share(p)).alias(f"{n}{p}") for p in probes for n, f in (("mean", F.avg), ("min", F.min))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("nprobe"), F.col(f"mean{p}").alias("mean_recall"), F.col(f"min{p}").alias("min_recall")) for p in probes])))


def calibrated(recalls: DataFrame, target: float) -> DataFrame:
    """recalls with ``chosen``: the least nprobe whose mean recall reaches the target, else the one nearest to it (the smaller among equals)."""
    order = F.struct((F.col("mean_recall") < target).cast("int"), F.when(F.col("mean_recall") < target, F.abs(F.col("mean_recall") - target)).otherwise(0.0), F.col("nprobe"))
    best = recalls.agg(F.min_by("nprobe", order).alias("__best"))
    # one row
    return recalls.join(F.broadcast(best), F.lit(True)).select(*recalls.columns, (F.col("nprobe") == F.col("__best")).alias("chosen"))


def wide(found: DataFrame) -> DataFrame:
    """One row per query with arrays of ids and distances in order of rank."""
    a = F.sort_array(F.collect_list(F.struct("rank", "support_id", "d2")))
    return found.groupBy("query_id").agg(a.alias("a")).select("query_id", F.col("a.support_id").alias("support_ids"), F.col("a.d2").alias("d2s"))
