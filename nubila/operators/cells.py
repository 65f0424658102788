"""Occupied cells of voxel grids: first members, counts, neighbours and octree levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import morton, quantise, serialized
from .ranks import running

CELL = ("batch", "gx", "gy", "gz")
#: Own cell first, then the one below and the one above along each axis.
OFFSETS = (0, -1, 1)


def with_cells(points: DataFrame, size: float, shift: float = 0.0, names=("gx", "gy", "gz")) -> DataFrame:
    return points.withColumns({g: quantise(F.col(a) + F.lit(float(shift)), size) for g, a in zip(names, "xyz")})


def coarsen(df: DataFrame, by: int, names=("gx", "gy", "gz"), out=("px", "py", "pz")) -> DataFrame:
    """Cells 2**by as wide; shifting rounds down for negative cells too."""
    return df.withColumns({o: F.shiftright(F.col(n), by) for n, o in zip(names, out)})


def voxel_first(points: DataFrame, size: float, shift: float = 0.0) -> DataFrame:
    """The point with the smallest id of each occupied voxel: one aggregation, combined in each map task."""
    cells = with_cells(points, size, shift)
    rest = [c for c in cells.columns if c not in CELL]
    first = cells.groupBy(*CELL).agg(F.min_by(F.struct(*rest), "point_id").alias("p"))
    return first.select(*CELL, *[F.col(f"p.{c}").alias(c) for c in rest])


def voxel_counts(points: DataFrame, size: float, shift: float = 0.0) -> DataFrame:
    return with_cells(points, size, shift).groupBy(*CELL).agg(F.count("*").alias("cnt"))


def run_lengths(counts: DataFrame) -> DataFrame:
    """Key, rank and running start of each cell within its batch, in key order."""
    keyed = counts.select(*CELL, "cnt", morton(F.col("gx"), F.col("gy"), F.col("gz"), F.col("batch")).alias("key"))
    out = running(keyed, ["batch"], ["key"], ("cnt",), name="rank")
    return out.select(*CELL, "cnt", "key", (F.col("rank") + 1).alias("rank"), F.col("cnt_before").alias("start"))


def cluster_ids(points: DataFrame, size: float, shift: float = 0.0) -> DataFrame:
    """points with ``cluster``, the number from 0 on of its cell among all occupied cells by batch and cell."""
    at = with_cells(points, size, shift)
    numbered = running(at.select(*CELL).distinct(), [], list(CELL), name="cluster")
    return at.join(numbered, list(CELL)).select(*points.columns, "cluster")


def around(names=("gx", "gy", "gz"), reach=OFFSETS) -> Column:
    """The neighbouring cells of a row, own cell first, as an array of structs to explode."""
    cells = [
        F.struct(F.lit(i).alias("nbr_pos"), *[(F.col(n) + d).alias(n) for n, d in zip(names, offset)])
        for i, offset in enumerate((a, b, c) for a in reach for b in reach for c in reach)
    ]
    return F.explode(F.array(*cells))


def exploded(df: DataFrame, names=("gx", "gy", "gz"), keep_pos: bool = False) -> DataFrame:
    """Each row once per neighbouring cell; its own cell columns become the neighbour's."""
    rest = [c for c in df.columns if c not in names]
    out = df.select(*rest, around(names).alias("n"))
    return out.select(*rest, *[F.col(f"n.{c}").alias(c) for c in names], *([F.col("n.nbr_pos")] if keep_pos else []))


def cell_neighbors(counts: DataFrame) -> DataFrame:
    """Occupied neighbours of occupied cells: (batch, gx, gy, gz, nbr_pos, nx, ny, nz, cnt)."""
    own = counts.select(*CELL, F.col("gx").alias("ox"), F.col("gy").alias("oy"), F.col("gz").alias("oz"))
    met = exploded(own, keep_pos=True).join(counts, list(CELL))
    return met.select("batch", F.col("ox").alias("gx"), F.col("oy").alias("gy"), F.col("oz").alias("gz"), "nbr_pos", F.col("gx").alias("nx"), F.col("gy").alias("ny"), F.col("gz").alias("nz"), "cnt")


def candidate_counts(counts: DataFrame) -> DataFrame:
    """Points in the 27 cells around each occupied cell."""
    return cell_neighbors(counts).groupBy(*CELL).agg(F.sum("cnt").alias("candidates"))


def representatives(points: DataFrame, size: float, shift: float = 0.0) -> DataFrame:
    """The middle member in key order of each cell that is two voxels wide."""
    cells = coarsen(with_cells(points, size, shift), 1)
    w = Window.partitionBy("batch", "px", "py", "pz")
    key = morton(F.col("gx"), F.col("gy"), F.col("gz"))
    ranked = cells.withColumns({"rn": F.row_number().over(w.orderBy(key, "point_id")), "cnt": F.count("*").over(w)})
    return ranked.where("rn - 1 = cnt div 2").select("point_id", "batch", "px", "py", "pz", "cnt")


def octree(points: DataFrame, size: float, levels: int, shift: float = 0.0) -> DataFrame:
    """Counts of the occupied cells of all levels 0..levels in one aggregation."""
    cells = with_cells(points, size, shift)
    each = cells.select("batch", "gx", "gy", "gz", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    return each.groupBy("level", "batch", *[F.call_function("shiftright", F.col(g), F.col("level")).alias(g) for g in ("gx", "gy", "gz")]).agg(F.count("*").alias("cnt"))


def octree_select(points: DataFrame, size: float, levels: int, k: int, low: int = 2, high: int = 8, shift: float = 0.0) -> DataFrame:
    """The level at which each point searches: from the coarsest, descend while there are over high*k candidates and the
    finer level still has low*k."""
    counts = octree(points, size, levels, shift)
    own = counts.select("level", "batch", "gx", "gy", "gz", F.col("gx").alias("ox"), F.col("gy").alias("oy"), F.col("gz").alias("oz"))
    cand = exploded(own).join(counts, ["level", *CELL]).groupBy("level", "batch", "ox", "oy", "oz").agg(F.sum("cnt").alias("n"))
    cells = with_cells(points, size, shift).select("point_id", "batch", "gx", "gy", "gz", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    cells = cells.select("point_id", "batch", "level", *[F.call_function("shiftright", F.col(g), F.col("level")).alias(o) for g, o in (("gx", "ox"), ("gy", "oy"), ("gz", "oz"))])
    lists = cells.join(cand, ["level", "batch", "ox", "oy", "oz"]).groupBy("point_id", "batch").agg(F.sort_array(F.collect_list(F.struct("level", "n")), asc=False).alias("a"))
    start = F.struct(F.element_at("a", 1)["level"].alias("level"), F.element_at("a", 1)["n"].alias("n"), F.lit(False).alias("done"))

    def step(acc, x):
        go = (~acc["done"]) & (acc["n"] > high * k) & (x["n"] >= low * k)
        return F.struct(F.when(go, x["level"]).otherwise(acc["level"]).alias("level"), F.when(go, x["n"]).otherwise(acc["n"]).alias("n"), (~go).alias("done"))

    chosen = F.aggregate(F.slice("a", 2, levels + 1), start, step)
    return lists.select("point_id", "batch", chosen["level"].alias("level"), chosen["n"].alias("candidates"))


def candidate_distribution(counts: DataFrame, by: tuple[str, ...] = ("batch",)) -> DataFrame:
    """Candidates of a point's query over all points of each group: points, mean, lower median, percentiles, extremes."""
    each = candidate_counts(counts).join(counts.select(*CELL, "cnt"), list(CELL))
    p = lambda q: F.percentile("candidates", F.lit(q), F.col("cnt"))
    # the lower median: the least value that half of the points don't exceed
    total = each.groupBy(*by).agg(F.sum("cnt").alias("points"), (F.sum(F.col("candidates") * F.col("cnt")) / F.sum("cnt")).alias("mean"), F.min("candidates").alias("minimum"), F.max("candidates").alias("maximum"), *[p(q).alias(n) for q, n in ((0.05, "p05"), (0.25, "p25"), (0.75, "p75"), (0.95, "p95"))])
    w = Window.partitionBy(*by).orderBy("candidates").rowsBetween(Window.unboundedPreceding, 0)
    steps = each.groupBy(*by, "candidates").agg(F.sum("cnt").alias("c"))
    median = steps.withColumn("upto", F.sum("c").over(w)).join(total.select(*by, "points"), list(by)).where("2 * upto >= points").groupBy(*by).agg(F.min("candidates").alias("median"))
    return total.join(median, list(by))


def mean_over_groups(distribution: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, groups, points, means of the columns) of candidate_distribution() rows, each group counting alike."""
    numbers = [c for c in distribution.columns if c in ("mean", "median", "minimum", "maximum", "p05", "p25", "p75", "p95")]
    return distribution.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("points").alias("points"), *[F.avg(c).alias(c) for c in numbers])


def candidate_bands(counts: DataFrame, low: int, high: int) -> DataFrame:
    """Points whose query has fewer than low, low to high, or more than high candidates, with the mean of each band."""
    each = candidate_counts(counts).join(counts.select(*CELL, "cnt"), list(CELL))
    band = F.when(F.col("candidates") < low, "few").when(F.col("candidates") <= high, "some").otherwise("many")
    return each.groupBy(band.alias("band")).agg(F.sum("cnt").alias("points"), (F.sum(F.col("candidates") * F.col("cnt")) / F.sum("cnt")).alias("mean"))


def serialized_order(coded: DataFrame, code: str = "code") -> DataFrame:
    """(batch, point_id, position): where a point stands in its batch's order by code; order[position] gives it back."""
    return running(coded.select("batch", "point_id", F.col(code).alias("code")), ["batch"], ["code", "point_id"]).select("batch", "point_id", "position")


def serialization(points: DataFrame, orders: tuple[str, ...] = ("z", "z-trans", "hilbert", "hilbert-trans"), depth: int | None = None) -> DataFrame:
    """(order, point_id, batch, depth, code, position): each point's key and place in several orders of the whole table at once.

    points has non-negative cells gx, gy, gz.  Without ``depth`` the cube is as deep as its largest cell needs.  Keys begin with the batch,
    so batches follow each other; equal keys are in order of ids.  position is the inverse of the order: the row at place p of an
    order is the one whose position is p.  All orders are placed by one shuffle.
    """
    if depth is None:
        top = points.agg(F.max(F.greatest("gx", "gy", "gz")).alias("m")).first().m
        depth = max(1, int(top or 0).bit_length())
    if depth > 16:
        raise ValueError(f"a depth of {depth} doesn't fit the key's 48 bits")
    coded = None
    for order in orders:
        one = serialized(points.select("point_id", *CELL), order, depth).select(F.lit(order).alias("order"), "point_id", "batch", F.lit(depth).alias("depth"), "code")
        coded = one if coded is None else coded.unionByName(one)
    return running(coded, ["order"], ["code", "point_id"])
