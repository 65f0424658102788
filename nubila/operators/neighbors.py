"""Gathering, interpolation and aggregation over neighbour tables (query_id, rank, support_id, d2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn import knn_exact
from .ranks import with_groups


def gathered(nbrs: DataFrame, points: DataFrame, columns: tuple[str, ...], *, own: tuple[str, ...] = ()) -> DataFrame:
    """Neighbour columns as n_*, and the query's own as q_*."""
    s = points.select(F.col("point_id").alias("support_id"), *[F.col(c).alias(f"n_{c}") for c in columns])
    out = nbrs.join(s, "support_id", "left")
    if own:
        out = out.join(points.select(F.col("point_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in own]), "query_id")
    return out


def group_relative(nbrs: DataFrame, points: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours' coordinates relative to the query's and their features; zero where there is no neighbour."""
    g = gathered(nbrs, points, ("x", "y", "z", *features), own=("x", "y", "z"))
    return g.select("query_id", "rank", "support_id", *[F.coalesce(F.col(f"n_{a}") - F.col(f"q_{a}"), F.lit(0.0)).alias(f"d{a}") for a in "xyz"], *[F.coalesce(f"n_{f}", F.lit(0.0)).alias(f) for f in features])


def dilated(nbrs: DataFrame, nsample: int, dilation: int) -> DataFrame:
    """Every (dilation+1)-th rank."""
    return nbrs.where((F.col("rank") - 1) % (dilation + 1) == 0).withColumn("rank", ((F.col("rank") - 1) / (dilation + 1)).cast("long") + 1).where(F.col("rank") <= nsample)


def interpolate(nbrs: DataFrame, points: DataFrame, features: tuple[str, ...], eps: float = 1e-8, inside_root: bool = False) -> DataFrame:
    """Features averaged with weights 1/(distance + eps)."""
    d = F.sqrt(F.col("d2") + eps) if inside_root else F.sqrt("d2") + eps
    g = gathered(nbrs, points, features).withColumn("w", F.lit(1.0) / d)
    return g.groupBy("query_id").agg(*[(F.sum(F.col("w") * F.col(f"n_{f}")) / F.sum("w")).alias(f) for f in features])


def subtract(nbrs: DataFrame, points: DataFrame, features: tuple[str, ...]) -> DataFrame:
    g = gathered(nbrs, points, features, own=features)
    return g.select("query_id", "rank", *[(F.col(f"q_{f}") - F.col(f"n_{f}")).alias(f) for f in features])


def aggregate(nbrs: DataFrame, points: DataFrame, features: tuple[str, ...], position: Column, weight: Column) -> DataFrame:
    """Sum over neighbours of (feature + position) * weight."""
    g = gathered(nbrs, points, features)
    return g.groupBy("query_id").agg(*[F.sum((F.col(f"n_{f}") + position) * weight).alias(f) for f in features])


def edge_max(nbrs: DataFrame, points: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """The largest neighbour feature less the query's own."""
    g = gathered(nbrs, points, features, own=features)
    return g.groupBy("query_id").agg(*[(F.max(f"n_{f}") - F.max(f"q_{f}")).alias(f) for f in features])


def attention_relation(nbrs: DataFrame, points: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Dot product of query and neighbour features along each edge."""
    g = gathered(nbrs, points, features, own=features)
    dot = sum((F.col(f"q_{f}") * F.col(f"n_{f}") for f in features[1:]), F.col(f"q_{features[0]}") * F.col(f"n_{features[0]}"))
    return g.select("query_id", "rank", "support_id", dot.alias("relation"))


def scatter_softmax(edges: DataFrame, value: str, group: str = "query_id", out: str = "weight") -> DataFrame:
    w = Window.partitionBy(group)
    e = edges.withColumn("__e", F.exp(F.col(value) - F.max(value).over(w)))
    return e.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def attention_fusion(edges: DataFrame, points: DataFrame, weight: str, features: tuple[str, ...]) -> DataFrame:
    """Sum over edges of weight times the neighbour's features."""
    g = gathered(edges, points, features)
    return g.groupBy("query_id").agg(*[F.sum(F.col(weight) * F.col(f"n_{f}")).alias(f) for f in features])


def relative_position_terms(edges: DataFrame, table: DataFrame, features: DataFrame) -> DataFrame:
    """Dot products of query features with the table rows that an edge's relative indices name, summed over axes.

    edges (query_id, support_id, axis, rel_index), table (axis, rel_index, c, value), features (query_id, c, value).
    """
    t = table.withColumnRenamed("value", "t")
    return edges.join(t, ["axis", "rel_index"]).join(features, ["query_id", "c"]).groupBy("query_id", "support_id").agg(F.sum(F.col("t") * F.col("value")).alias("bias"))


def gaussian_weight(nbrs: DataFrame, a: float = 1.0, c: float = 5.0) -> DataFrame:
    """nbrs with weight a * exp(-d2 / (2 c**2))."""
    return nbrs.withColumn("weight", a * F.exp(-F.col("d2") / (2 * c * c)))


def interpolate_given(nbrs: DataFrame, points: DataFrame, features: tuple[str, ...], weight: str = "weight") -> DataFrame:
    """Sums of the neighbours' features times weights that nbrs holds."""
    near = points.select(F.col("point_id").alias("support_id"), *features)
    return nbrs.join(near, "support_id").groupBy("query_id").agg(*[F.sum(F.col(weight) * F.col(f)).alias(f) for f in features])


def group_all(points: DataFrame, features: tuple[str, ...] = (), use_xyz: bool = True) -> DataFrame:
    """One group per batch that holds all of its points: (batch, group_id 0, point_id[, x, y, z], features)."""
    return points.select("batch", F.lit(0).alias("group_id"), "point_id", *(("x", "y", "z") if use_xyz else ()), *features)


def soft_dilated(points: DataFrame, n: int, dilation: int, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, slot, support_id, d2): n neighbours at every (dilation + 1)-th rank, slots counting from 0; in a batch with too few points for
    that the ranks are spread evenly over what there is, rounded down, and may repeat."""
    total = 1 + (n - 1) * (dilation + 1)
    found = knn_exact(points, total, queries=queries)
    asked = (queries if queries is not None else points).select(F.col("point_id").alias("query_id"), "batch")
    asked = with_groups(asked, points.groupBy("batch").agg(F.count("*").alias("cnt")), ["batch"])
    step = F.when(F.col("cnt") < total, (F.col("cnt") - 1) / max(n - 1, 1) - 1).otherwise(F.lit(float(dilation))) + 1
    slots = asked.withColumn("step", step).select("query_id", "step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    wanted = slots.select("query_id", "slot", (F.floor(F.col("step") * F.col("slot")) + 1).alias("rank"))
    return wanted.join(found, ["query_id", "rank"]).select("query_id", "slot", "support_id", "d2")


def unpool_interpolated(fine: DataFrame, coarse: DataFrame, features: tuple[str, ...], k: int = 3, add: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, features): each fine point's mean of its k nearest coarse points' features by inverse distance, plus its own columns in add."""
    near = interpolate(knn_exact(coarse, k, queries=fine), coarse, features)
    if not add:
        return near
    own = fine.select(F.col("point_id").alias("query_id"), *[F.col(f).alias(f"__{f}") for f in add])
    return near.join(own, "query_id").select("query_id", *[(F.col(f) + F.col(f"__{f}") if f in add else F.col(f)).alias(f) for f in features])


# attention by heads with relative positions: features and tables have an array of values per head
#   features  (point_id, head, value array<double>)
#   tables    (axis, rel_index, head, value array<double>)
#   edges     (query_id, support_id), places (query_id, support_id, axis, rel_index)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def relative_places(edges: DataFrame, points: DataFrame, size: float, levels: int) -> DataFrame:
    """(query_id, support_id, axis, rel_index): along each axis the cell of the difference query - support among ``levels``, the middle one
    for none; differences beyond count as the outermost."""
    side = lambda n, s: points.select(F.col("point_id").alias(n), *[F.col(a).alias(f"{s}{a}") for a in "xyz"])
    both = edges.select("query_id", "support_id").join(side("query_id", "q"), "query_id").join(side("support_id", "s"), "support_id")
    cell = lambda a: F.least(F.greatest(F.floor((F.col(f"q{a}") - F.col(f"s{a}")) / size) + levels // 2, F.lit(0)), F.lit(levels - 1)).cast("int")
    return both.select("query_id", "support_id", F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), cell(a).alias("rel_index")) for i, a in enumerate("xyz")])).alias("p")).select("query_id", "support_id", "p.*")


def head_relation(edges: DataFrame, query: DataFrame, key: DataFrame) -> DataFrame:
    """(query_id, support_id, head, relation): the dot product of each head's query and key values along each edge."""
    q = query.select(F.col("point_id").alias("query_id"), "head", F.col("value").alias("__q"))
    k = key.select(F.col("point_id").alias("support_id"), "head", F.col("value").alias("__k"))
    return edges.select("query_id", "support_id").join(q, "query_id").join(k, ["support_id", "head"]).select("query_id", "support_id", "head", _dot("__q", "__k").alias("relation"))


def head_bias(places: DataFrame, sides: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(query_id, support_id, head, bias): over axes and sides, dot products of a point's values with its table's row.

    sides: (the edge's end, query_id or support_id; features; table).  A point meets a row once, whatever the number of its edges that
    have it, and edges take the products up by a join.
    """
    out = None
    for end, features, table in sides:
        spots = places.select(F.col(end).alias("point_id"), "axis", "rel_index").distinct()
        row = table.withColumnRenamed("value", "__t")
        met = spots.join(F.broadcast(row) if _small(table) else row, ["axis", "rel_index"]).join(features, ["point_id", "head"])
        products = met.select(F.col("point_id").alias(end), "axis", "rel_index", "head", _dot("value", "__t").alias("part"))
        one = places.join(products, [end, "axis", "rel_index"]).select("query_id", "support_id", "head", "part")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("query_id", "support_id", "head").agg(F.sum("part").alias("bias"))


def _small(table: DataFrame, rows: int = 100_000) -> bool:
    return table.limit(rows + 1).count() <= rows


def head_softmax(relations: DataFrame, value: str = "relation") -> DataFrame:
    """relations with ``weight``: softmax over the edges of each query and head, by two aggregations of each."""
    top = relations.groupBy("query_id", "head").agg(F.max(value).alias("__m"))
    e = relations.join(top, ["query_id", "head"]).withColumn("__e", F.exp(F.col(value) - F.col("__m")))
    total = e.groupBy("query_id", "head").agg(F.sum("__e").alias("__t"))
    return e.join(total, ["query_id", "head"]).withColumn("weight", F.col("__e") / F.col("__t")).drop("__e", "__m", "__t")


def head_values(weights: DataFrame, values: DataFrame, places: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """(query_id, head, c, value): per query and head the weighted sums of the neighbours' values and, with ``places`` and ``table``, of the
    table's rows at the edges' relative positions on all axes.

    Weights of edges at one position are added up before they meet the table, so a query meets each row once.
    """
    v = values.select(F.col("point_id").alias("support_id"), "head", "value")
    spread = lambda df, w: df.select("query_id", "head", F.posexplode(F.transform("value", lambda x: x * F.col(w))).alias("c", "part"))
    out = spread(weights.select("query_id", "support_id", "head", "weight").join(v, ["support_id", "head"]), "weight")
    if table is not None:
        at = weights.select("query_id", "support_id", "head", "weight").join(places, ["query_id", "support_id"]).groupBy("query_id", "head", "axis", "rel_index").agg(F.sum("weight").alias("weight"))
        out = out.unionByName(spread(at.join(F.broadcast(table) if _small(table) else table, ["axis", "rel_index", "head"]), "weight"))
    return out.groupBy("query_id", "head", "c").agg(F.sum("part").alias("value"))
