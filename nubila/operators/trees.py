"""Octrees as node tables: links to parents and children, and masks of occupied octants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import gather, morton
from ..session import checkpointed
from .ranks import running


def occupied(cells: DataFrame, depth: int) -> DataFrame:
    """(level, batch, key, points, mask, rank) of the occupied nodes of levels 0..depth.

    cells has batch, gx, gy, gz (non-negative, below 2**depth).  A level's key is the leaf's without 3 bits a level; mask has
    a bit per octant that holds points, 0 at the leaves; rank counts a level's occupied nodes by batch and key.  Leaves are
    counted first, then all their ancestors are combined in one more aggregation.
    """
    leaves = cells.groupBy("batch", morton(F.col("gx"), F.col("gy"), F.col("gz")).alias("leaf")).agg(F.count("*").alias("points"))
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    rise = lambda by: F.expr(f"shiftright(leaf, 3 * ({depth} - level + {by}))")
    octant = F.when(F.col("level") < depth, F.expr(f"shiftleft(1, cast(shiftright(leaf, 3 * ({depth} - level - 1)) & 7 as int))")).otherwise(0)
    nodes = up.groupBy("level", "batch", rise(0).alias("key")).agg(F.sum("points").alias("points"), F.bit_or(octant).alias("mask"))
    return running(nodes, ["level"], ["batch", "key"], name="rank")


def _nodes(level: Column) -> Column:
    """The number of nodes of a full level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (3 * level).cast("int"))


def octree_nodes(cells: DataFrame, depth: int | None = None, full_depth: int = 2) -> DataFrame:
    """(level, batch, key, x, y, z, index, parent, child, mask, points): every node of an octree over each batch.

    Levels up to ``full_depth`` have all 8**level nodes of each batch, at batch * 8**level + key; below, each occupied node
    has all its 8 octants, at 8 * rank + octant, where rank counts the occupied nodes of the level above.  child is a node's own
    such rank, -1 if it is empty or a leaf; its children are those at 8 * child (below the full levels).  parent is the
    index on the level above, -1 for roots.  mask and points are 0 for empty nodes.  Batches count from 0.  Without ``depth``
    the tree is as deep as the largest cell plus one needs.
    """
    if depth is None:
        top = cells.agg(F.max(F.greatest("gx", "gy", "gz")).alias("m")).first().m
        depth = (int(top) + 1).bit_length() if top is not None else full_depth
    if depth > 16:
        raise ValueError(f"a depth of {depth} doesn't fit the key's 48 bits")
    full_depth = min(full_depth, depth)
    occ = checkpointed(occupied(cells, depth))
    # the index of each occupied node
    above = occ.select((F.col("level") + 1).alias("level"), "batch", F.col("key").alias("__up"), F.col("rank").alias("__uprank"))
    within = F.col("batch") * _nodes(F.col("level")) + F.col("key")
    at = occ.withColumn("__up", F.shiftright("key", 3)).join(above, ["level", "batch", "__up"], "left")
    at = at.select("level", "batch", "key", "points", "mask", "rank", F.when(F.col("level") <= full_depth, within).otherwise(8 * F.col("__uprank") + F.col("key").bitwiseAND(F.lit(7))).alias("index"))
    octants = at.where((F.col("level") >= full_depth) & (F.col("level") < depth)).select((F.col("level") + 1).alias("level"), "batch", F.col("key").alias("__up"), F.col("rank").alias("__uprank"), F.col("index").alias("parent"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("octant"))
    deep = octants.select("level", "batch", (8 * F.col("__up") + F.col("octant")).alias("key"), (8 * F.col("__uprank") + F.col("octant")).alias("index"), "parent")
    each = occ.where("level = 0").select("batch", F.explode(F.sequence(F.lit(0), F.lit(full_depth))).alias("level"))
    each = each.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), _nodes(F.col("level")) - 1)))
    over = F.when(F.col("level") == 0, -1).otherwise(F.col("batch") * _nodes(F.greatest(F.col("level") - 1, F.lit(0))) + F.shiftright("key", 3))
    nodes = each.select("level", "batch", "key", within.alias("index"), over.alias("parent")).unionByName(deep)
    out = nodes.join(occ.select("level", "batch", "key", "points", "mask", "rank"), ["level", "batch", "key"], "left")
    child = F.when(F.col("level") < depth, F.coalesce("rank", F.lit(-1).cast("long"))).otherwise(-1)
    xyz = {a: gather(F.shiftright("key", 2 - i)) for i, a in enumerate("xyz")}
    return out.select("level", "batch", "key", *[c.alias(a) for a, c in xyz.items()], "index", "parent", child.alias("child"), F.coalesce("mask", F.lit(0)).cast("int").alias("mask"), F.coalesce("points", F.lit(0).cast("long")).alias("points"))


def sparse_tensor(cells: DataFrame, pad: int = 96) -> tuple[DataFrame, tuple[int, int, int]]:
    """(batch, gx, gy, gz, row) in order of rows, and the shape that holds all cells with ``pad`` to spare along each axis."""
    top = cells.agg(*[F.max(g).alias(g) for g in ("gx", "gy", "gz")]).first()
    placed = running(cells.select("batch", "point_id", "gx", "gy", "gz"), [], ["batch", "point_id"], name="row")
    return placed, tuple(int(v) + pad if v is not None else pad for v in top)
