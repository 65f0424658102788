"""Radius joins with several rules for which hits stay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import Search, nearest, within
from .cells import exploded, with_cells
from .knn import P, candidates
from .ranks import with_groups

#: Points of a cell that the first round of ball_query() looks at, by how much more each further round takes, rows packed together.
HEADS, MORE, PACK = 128, 8, 2048


def hits(points: DataFrame, radius: float, *, queries: DataFrame | None = None, min_radius: float = 0.0, shift: float = 0.0) -> DataFrame:
    """All (query_id, support_id, d2) with min_radius**2 <= d2 < radius**2, or d2 <= 1e-5 where min_radius is set: among 27 cells as wide
    as the radius, which hold every hit nearer than it.  Ids are whole numbers."""
    low, high = min_radius * min_radius, radius * radius
    also = 1e-5 if min_radius > 0 else None
    return within(points, low, high, also, queries, (float(radius), float(shift), 0) if also is not None and also >= high else None)


def lcg(c: Column, seed: int) -> Column:
    """A fixed arithmetic scramble of ids that SQL engines share."""
    return (c * 1103515245 + 12345 + seed) % 2147483648


def _picked(nsample: int, inside, even: bool):
    """The hits that stay of a group's queries (rows with an id) among its points (the other rows, packed)."""
    names = ["query_id", "rank", "support_id", "d2"]

    def run(table: pa.Table) -> pa.Table:
        flat = pa.concat_arrays([c.flatten() for c in table.column("pts").chunks])
        o, ids, *s, last = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
        order = np.lexsort((ids, o))
        # beyond the first one of a cell's points that are not all here, hits may be missing
        beyond = np.flatnonzero(last[order])
        order = order[: beyond[0]] if len(beyond) else order
        ids, s = ids[order], [c[order] for c in s]
        asked = table.filter(pc.is_valid(table.column("point_id")))
        qid, *q = (asked.column(c).to_numpy() for c in ("point_id", "x", "y", "z"))
        step, nth, parts = max(1, (1 << 17) // max(1, len(ids))), np.arange(nsample), []
        for lo in range(0, len(qid), step):
            d = q[0][lo : lo + step, None] - s[0]
            d *= d
            for i in (1, 2):
                e = q[i][lo : lo + step, None] - s[i]
                e *= e
                d += e
            row, col = np.nonzero(inside(d))
            cnt = np.bincount(row, minlength=len(d))
            at = nth * cnt[:, None] // nsample if even else nth
            at = np.where(cnt[:, None] <= nsample, nth, at) + (np.cumsum(cnt) - cnt)[:, None]
            i, j = np.nonzero(nth < (cnt[:, None] if not len(beyond) else np.where(cnt < nsample, 0, cnt)[:, None]))
            hit = at[i, j]
            parts.append((qid[lo + i], j + 1, ids[col[hit]], d[i, col[hit]], np.ones(len(i), bool)))
            if len(beyond):
                # asked again, with more points
                left = qid[lo : lo + step][cnt < nsample]
                parts.append((left, np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), np.zeros(len(left)), np.zeros(len(left), bool)))
        out = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, bool)]
        return pa.table({n: pa.array(c, mask=None if n in names[:2] else ~out[4]) for n, c in zip(names, out)})

    return run


def _asked(q: DataFrame, s: DataFrame, heads: int | None, pick) -> DataFrame:
    """Rows of ``pick`` for the queries among the first ``heads`` points of each cell around them, all points if that is None.

    Points go packed, by cell, to the packs of queries of the 27 cells around it.
    """
    cell, own = ["batch", *P], ["kx", "ky", "kz"]
    many = lambda c: F.greatest(F.lit(1), F.ceil(c / PACK)).cast("long")
    deal = lambda df, i: with_groups(df, df.groupBy(*cell).agg(many(F.count("*")).alias("packs")), cell).withColumn("pack", F.pmod(F.xxhash64(i), F.col("packs")))
    if heads is None:
        s = deal(s, "id").withColumn("last", F.lit(False))
    else:
        # Spark cuts each cell before the exchange too
        s = s.withColumn("rn", F.row_number().over(Window.partitionBy(*cell).orderBy("o", "id"))).where(F.col("rn") <= heads + 1)
        s = s.withColumns({"last": F.col("rn") > heads, "pack": F.expr(f"(rn - 1) div {PACK}")})
    packed = s.groupBy(*cell, "pack").agg(F.collect_list(F.struct("o", "id", "x", "y", "z", "last")).alias("pts")).drop("pack")
    packs = q.groupBy(*cell).agg(many(F.count("*")).alias("packs")).select(*cell, *[F.col(p).alias(k) for p, k in zip(P, own)], F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)).alias("pack"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("point_id", "long"), ("x", "double"), ("y", "double"), ("z", "double"))]
    theirs = exploded(packs, P).join(packed, cell).select("batch", *own, "pack", *none, "pts")
    mine = deal(q, "point_id").select("batch", *[F.col(p).alias(k) for p, k in zip(P, own)], "pack", "point_id", "x", "y", "z", F.lit(None).cast(packed.schema["pts"].dataType).alias("pts"))
    return theirs.unionByName(mine).groupBy("batch", *own, "pack").applyInArrow(pick, "query_id long, rank long, support_id long, d2 double")


def ball_query(points: DataFrame, radius: float, nsample: int, *, mode: str = "even", seed: int = 0, queries: DataFrame | None = None, min_radius: float = 0.0, shift: float = 0.0) -> DataFrame:
    """At most nsample hits of each query.

    mode: first (by id), even (ranks floor(cnt * i / nsample) of the hits by id where there are more than nsample), random (by a seeded
    scramble of ids) or nearest.

    No pairs are shuffled: points go in packs to the queries around them.  first and random look at each cell's first points in the order
    asked for; hits that precede whatever is missing are final, and the queries that lack some ask again with more points, so a query in a
    crowded place is settled by few of them.  even needs all hits' number and compares all points of 27 cells.  Ids are whole numbers.
    """
    asking = queries if queries is not None else points
    low, high = min_radius * min_radius, radius * radius
    if mode == "nearest":
        if min_radius > 0:
            w = Window.partitionBy("query_id").orderBy("d2", "support_id")
            near = hits(points, radius, queries=queries, min_radius=min_radius, shift=shift).withColumn("rank", F.row_number().over(w).cast("long"))
            return near.where(F.col("rank") <= nsample).select("query_id", "rank", "support_id", "d2")
        return nearest(points, Search(nsample, cut=high), queries)
    order = {"first": F.col("point_id"), "even": F.col("point_id"), "random": lcg(F.col("point_id"), seed)}[mode].cast("long")
    row = lambda df, i: [F.col("point_id").cast("long").alias(i), "batch", *[F.col(a).cast("double").alias(a) for a in "xyz"], *P]
    whole = lambda df: df.where(" and ".join(f"{c} is not null" for c in ("batch", *P)))
    s = whole(with_cells(points, radius, shift, P)).select(order.alias("o"), *row(points, "id"))
    q = whole(with_cells(asking, radius, shift, P)).select(*row(asking, "point_id"))

    def inside(d: np.ndarray) -> np.ndarray:
        return (d < high) if min_radius <= 0 else ((d >= low) & (d < high)) | (d <= 1e-5)

    pick = _picked(nsample, inside, mode == "even")
    if mode == "even":
        out = _asked(q, s, None, pick)
    else:
        out, heads, left = None, HEADS, q
        while True:
            found = checkpointed(_asked(left, s, heads, pick))
            ready = found.where("rank > 0")
            out = ready if out is None else out.unionByName(ready)
            again = found.where("rank = 0").select(F.col("query_id").alias("point_id"))
            if again.isEmpty():
                break
            left, heads = q.join(again, "point_id", "left_semi"), heads * MORE
    kinds = {"query_id": asking.schema["point_id"].dataType, "support_id": points.schema["point_id"].dataType}
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in out.columns])


def match_pairs(left: DataFrame, right: DataFrame, max_k: int, radius: float, shift: float = 0.0, seed: int = 0) -> DataFrame:
    """For each left point one of its max_k nearest right points within the radius, chosen by a seeded scramble."""
    near = ball_query(right, radius, max_k, mode="nearest", queries=left, shift=shift)
    return near.groupBy("query_id").agg(F.min_by(F.struct("support_id", "d2"), F.struct(lcg(F.col("support_id"), seed), "support_id")).alias("m")).select("query_id", "m.support_id", "m.d2")


def overlap(points: DataFrame, voxel: float, reach: float = 1.5, shift: float = 0.0) -> DataFrame:
    """For pairs of clouds a < b: the larger of the shares of either's voxels with a voxel of the other within reach*voxel."""
    from .cells import voxel_first

    kept = voxel_first(points, voxel, shift).select("point_id", "batch", "x", "y", "z")
    near = hits(kept.withColumn("cloud", F.col("batch")).withColumn("batch", F.lit(0)), reach * voxel, shift=shift).select("query_id", "support_id")
    cloud = kept.select("point_id", "batch")
    met = near.join(cloud.withColumnsRenamed({"point_id": "query_id", "batch": "a"}), "query_id").join(cloud.withColumnsRenamed({"point_id": "support_id", "batch": "b"}), "support_id").where("a <> b")
    share = met.select("query_id", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
    share = share.join(cloud.groupBy(F.col("batch").alias("a")).agg(F.count("*").alias("t")), "a").withColumn("share", F.col("n") / F.col("t"))
    return share.groupBy(F.least("a", "b").alias("cloud_a"), F.greatest("a", "b").alias("cloud_b")).agg(F.max("share").alias("overlap"))


def ball_padded(points: DataFrame, radius: float, nsample: int, *, pad: str = "first", mode: str = "first", queries: DataFrame | None = None, **how) -> DataFrame:
    """nsample slots of each query: its hits by ball_query(), then the first hit again (pad first) or id -1 at distance 1e10 (pad minus_one).

    A query without hits has null slots with pad first.
    """
    found = ball_query(points, radius, nsample, mode=mode, queries=queries, **how)
    asking = (queries if queries is not None else points).select(F.col("point_id").alias("query_id"))
    slots = asking.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(nsample).cast("long"))).alias("rank"))
    out = slots.join(found, ["query_id", "rank"], "left").withColumn("is_padding", F.col("support_id").isNull())
    if pad == "minus_one":
        return out.select("query_id", "rank", F.coalesce("support_id", F.lit(-1)).alias("support_id"), F.coalesce("d2", F.lit(1e10)).alias("d2"), "is_padding")
    first = found.where("rank = 1").select("query_id", F.col("support_id").alias("s1"), F.col("d2").alias("e1"))
    return out.join(first, "query_id", "left").select("query_id", "rank", F.coalesce("support_id", "s1").alias("support_id"), F.coalesce("d2", "e1").alias("d2"), "is_padding")


def radius_l1(points: DataFrame, radius: float, max_neighbors: int | None = None, *, queries: DataFrame | None = None, shift: float = 0.0) -> DataFrame:
    """Points with an L1 distance below radius, nearest first; at most max_neighbors of each query, all if that is None."""
    if max_neighbors is not None:
        return nearest(points, Search(max_neighbors, "l1", cut=float(radius)), queries).select("query_id", F.col("rank").cast("int").alias("rank"), "support_id", F.col("d2").alias("distance"))
    near = candidates(queries if queries is not None else points, points, radius, shift, "l1").where(F.col("d2") < radius)
    w = Window.partitionBy("query_id").orderBy("d2", "support_id")
    return near.select("query_id", F.row_number().over(w).alias("rank"), "support_id", F.col("d2").alias("distance"))
