"""Window partitions, serialised patches, masks and refinement of part labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .ball import lcg
from .blocks import sharing
from .cells import voxel_first, with_cells
from .knn import knn_exact
from .ranks import running, with_groups
from .sampling import farthest_points


def window_pairs(points: DataFrame, window: float, small: float | None = None, shift: float = 0.0) -> DataFrame:
    """Ordered pairs of points of one window; with ``small``, only of points in different small windows.

    The result is the pair table itself, so windows should be chosen small.  A window's points, in the order of their small windows, are
    packed into blocks that meet pairwise, so that a crowded window is dealt to many tasks.  Ids are whole numbers.
    """
    at = ["batch", "wx", "wy", "wz"]
    w = with_cells(points, window, shift, at[1:])
    w = with_cells(w, small or window, shift, ("sx", "sy", "sz")).select("point_id", *at, "sx", "sy", "sz")
    w = w.where(" and ".join(f"{c} is not null" for c in at))
    numbered = running(w.select(*at).distinct(), [], at, name="number")
    w = with_groups(w, numbered, at)
    return sharing(w.select("point_id", F.col("number").alias("batch"), *[F.col(f"s{a}").cast("double").alias(a) for a in "xyz"]), small is not None)


def patches(coded: DataFrame, size: int) -> DataFrame:
    """(batch, point_id, patch, place): each batch in code order in patches of ``size``; the last patch borrows from the one before."""
    r = running(coded.select("batch", "point_id", "code"), ["batch"], ["code", "point_id"], name="rn")
    r = with_groups(r, coded.groupBy("batch").agg(F.count("*").alias("cnt")), ["batch"])
    own = r.select("batch", "point_id", F.expr(f"rn div {size}").alias("patch"), (F.col("rn") % size).alias("place"), "rn", "cnt")
    tail = F.expr(f"(cnt - 1) div {size}")
    short = (F.col("cnt") % size != 0) & (F.col("cnt") > size)
    # places of the last patch count from cnt - size; the points before its own start are lent by the patch before
    own = own.withColumn("place", F.when(short & (F.col("patch") == tail), F.col("rn") - (F.col("cnt") - size)).otherwise(F.col("place")))
    lent = own.where(short & (F.col("patch") == tail - 1) & (F.col("rn") >= F.col("cnt") - size)).withColumns({"patch": tail, "place": F.col("rn") - (F.col("cnt") - size)})
    return own.unionByName(lent).select("batch", "point_id", "patch", "place")


def ravel_key(points: DataFrame, size: float, shift: float = 0.0) -> DataFrame:
    """Mixed-radix cell key: Horner's rule with each batch's largest cell plus one."""
    c = with_cells(points, size, shift)
    box = c.groupBy("batch").agg(*[f(f"g{a}").alias(f"__{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    low = with_groups(c, box, ["batch"]).withColumns({f"g{a}": F.col(f"g{a}") - F.col(f"__lo{a}") for a in "xyz"})
    wide = {a: F.col(f"__hi{a}") - F.col(f"__lo{a}") + 1 for a in "yz"}
    return low.withColumn("key", (F.col("gx") * wide["y"] + F.col("gy")) * wide["z"] + F.col("gz")).drop(*[f"__{n}{a}" for a in "xyz" for n in ("lo", "hi")])


def patches_around(points: DataFrame, anchors: int, k: int) -> DataFrame:
    """Farthest-point anchors and their k nearest points."""
    at = farthest_points(points, anchors).select("point_id")
    return knn_exact(points, k, queries=points.join(at, "point_id", "left_semi"))


def cross_masks(points: DataFrame, size: float, ratio: float, seed: int = 0, shift: float = 0.0) -> DataFrame:
    """Cells with mask 1 or 2 (disjoint, a share ``ratio`` of each batch's cells each) or 0, by a seeded scramble."""
    cells = voxel_first(points, size, shift).select("batch", "gx", "gy", "gz", "point_id", lcg(F.col("point_id"), seed).alias("draw"))
    r = with_groups(running(cells, ["batch"], ["draw", "point_id"], name="rn"), cells.groupBy("batch").agg(F.count("*").alias("cnt")), ["batch"])
    n = F.floor(F.col("cnt") * ratio)
    return r.select("batch", "gx", "gy", "gz", F.when(F.col("rn") < n, 1).when(F.col("rn") < 2 * n, 2).otherwise(0).alias("mask"))


def refine_parts(points: DataFrame, n: int = 10) -> DataFrame:
    """Replace predicted parts of fewer than n points of a cloud by the majority label of their n+1 nearest points.

    points has point_id, batch, x, y, z, pred; of equal counts the smallest label wins.
    """
    rare = points.groupBy("batch", "pred").agg(F.count("*").alias("c")).where(F.col("c") < n).select("batch", "pred")
    bad = points.join(rare, ["batch", "pred"], "left_semi")
    near = knn_exact(points.select("point_id", "batch", "x", "y", "z"), n + 1, queries=bad.select("point_id", "batch", "x", "y", "z"))
    votes = near.join(points.select(F.col("point_id").alias("support_id"), "pred"), "support_id").groupBy("query_id", "pred").agg(F.count("*").alias("c"))
    new = votes.groupBy(F.col("query_id").alias("point_id")).agg(F.min_by("pred", F.struct(-F.col("c"), "pred")).alias("better"))
    return points.join(new, "point_id", "left").select("point_id", "batch", F.coalesce("better", "pred").alias("pred"))


def accuracy(labels: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """Accuracy of each class, and overall with a null class."""
    hit = F.avg(F.when(F.col(target) == F.col(pred), 1.0).otherwise(0.0))
    return labels.groupingSets([[F.col(target)], []], F.col(target)).agg(hit.alias("accuracy"), F.count("*").alias("n")).select(F.col(target).alias("class"), "accuracy", "n")


def manifest(frames: DataFrame, n: int) -> DataFrame:
    """n evenly spaced frames of each sequence with a digest of what names them."""
    r = with_groups(running(frames.select("sequence", "frame"), ["sequence"], ["frame"], name="rn"), frames.groupBy("sequence").agg(F.count("*").alias("cnt")), ["sequence"])
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("cnt") - 1) / F.lit(max(n - 1, 1))))
    return r.where(F.array_contains(wanted, F.col("rn"))).select("sequence", "frame", F.sha2(F.concat_ws("/", F.col("sequence").cast("string"), F.col("frame").cast("string")), 256).alias("sha256"))


def lattice_noise(seed: int, axis: int) -> Column:
    """A standard normal number for each node (batch, ni, nj, nk) of the noise grid, by a fixed arithmetic scramble and Box-Muller."""
    # fixed values: factors of the scramble
    mixed = F.pmod(F.col("batch") * 15485863 + F.col("ni") * 7919 + F.col("nj") * 104729 + F.col("nk") * 1299709 + F.lit((seed * 3 + axis) * 32452843), F.lit(1 << 31))
    first = lcg(lcg(mixed, seed), axis)
    return F.sqrt(-2 * F.log((first + 1) / float((1 << 31) + 1))) * F.cos(2 * math.pi * lcg(first, seed) / float(1 << 31))


def elastic(points: DataFrame, granularity: float, magnitude: float, seed: int = 0) -> DataFrame:
    """Displace points by smooth noise: normal noise on the nodes of each batch's grid, averaged over three nodes along each axis and
    that twice, interpolated trilinearly.

    A batch's grid has its first node one ``granularity`` below the least coordinates and ends two beyond the last whole one; beyond it
    noise is 0.  Only the nodes that points look up, and those within two of them, are made.  Averages along an axis are
    joins with shifted nodes, the lookup a join of each point's 8 corners.
    """
    node, axes = ("ni", "nj", "nk"), tuple(zip("xyz", ("ni", "nj", "nk")))
    box = points.groupBy("batch").agg(*[f(a).alias(f"__{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    at = with_groups(points, box, ["batch"])
    place = {a: (F.col(a) - F.col(f"__lo{a}")) / granularity + 1 for a in "xyz"}
    at = at.withColumns({n: F.floor(place[a]) for a, n in axes} | {f"__f{a}": place[a] - F.floor(place[a]) for a in "xyz"})
    last = {n: F.floor((F.col(f"__hi{a}") - F.col(f"__lo{a}")) / granularity) + 2 for a, n in axes}
    at = at.withColumns({f"__t{n}": last[n] for _, n in axes})
    ends = [f"__t{n}" for n in node]
    corner = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{n}") for n, o in zip(node, (i, j, k))]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    looked = at.select("point_id", "batch", *node, *[f"__f{a}" for a in "xyz"], *ends, corner.alias("c"))
    weight = None
    for a, n in axes:
        w = F.when(F.col(f"c.o{n}") == 1, F.col(f"__f{a}")).otherwise(1 - F.col(f"__f{a}"))
        weight = w if weight is None else weight * w
    looked = looked.select("point_id", "batch", *ends, weight.alias("weight"), *[(F.col(n) + F.col(f"c.o{n}")).alias(n) for n in node])
    grid = looked.select("batch", *node, *ends).distinct()
    for n in node:
        around = F.explode(F.sequence(F.greatest(F.col(n) - 2, F.lit(0)), F.least(F.col(n) + 2, F.col(f"__t{n}"))))
        grid = grid.withColumn(n, around).distinct()
    noise = ("__n0", "__n1", "__n2")
    grid = checkpointed(grid.withColumns({c: lattice_noise(seed, i) for i, c in enumerate(noise)}))
    for _ in range(2):
        for n in node:
            shifted = grid.withColumn(n, F.explode(F.sequence(F.greatest(F.col(n) - 1, F.lit(0)), F.least(F.col(n) + 1, F.col(f"__t{n}")))))
            grid = shifted.groupBy("batch", *node, *ends).agg(*[(F.sum(c) / 3).alias(c) for c in noise])
        grid = checkpointed(grid)
    moved = looked.join(grid.drop(*ends), ["batch", *node]).groupBy("point_id").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in noise])
    out = points.join(moved, "point_id")
    return out.withColumns({a: F.col(a) + F.col(c) * magnitude for a, c in zip("xyz", noise)}).drop(*noise)


def group_lookup(vertices: DataFrame, groups: DataFrame, classes: DataFrame, ignore: int = -1) -> DataFrame:
    """(vertex, instance, class): vertices (vertex, segment) of groups (instance, category, segments), classes (category, class) if known."""
    members = groups.select("instance", "category", F.explode("segments").alias("segment"))
    return vertices.join(members, "segment", "left").join(classes, "category", "left").select("vertex", F.coalesce("instance", F.lit(ignore)).alias("instance"), F.coalesce("class", F.lit(ignore)).alias("class"))
