"""Average precision of predicted instances, from labelled points and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .ranks import running, with_groups

#: The overlaps at which matches are counted, and the points that an instance must have.
OVERLAPS, LEAST_POINTS = (0.25, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9), 100


def _ignored(ignore: tuple[int, ...]) -> Column:
    return F.coalesce(F.col("segment").isin(*ignore), F.lit(False)) if ignore else F.lit(False)


def instances(truth: DataFrame, ignore: tuple[int, ...] = (-1,), ignore_instance: int = -1) -> DataFrame:
    """(scene, instance, class, size) of the true instances; an instance's class is its first point's."""
    each = truth.where(F.col("instance") != ignore_instance).groupBy("scene", "instance").agg(F.min_by("segment", "point_id").alias("segment"), F.count("*").alias("size"))
    return each.where(~_ignored(ignore)).select("scene", "instance", F.col("segment").alias("class"), "size")


def overlaps(truth: DataFrame, masks: DataFrame, preds: DataFrame, *, ignore: tuple[int, ...] = (-1,), ignore_instance: int = -1, least: int = LEAST_POINTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instances, predictions, edges).

    predictions (scene, pred_id, class, score, psize, void): those with at least ``least`` points and a class that counts, with the
    number of their points of ignored classes.  edges (scene, class, instance, size, pred_id, score, psize, common, overlap): pairs
    of one class that share points.  One join of mask points with labelled points, counted in the map tasks first.
    """
    shared = masks.join(truth.select("scene", "point_id", "segment", "instance"), ["scene", "point_id"])
    # a row per pair that shares points: all that follows is read from it several times
    hits = checkpointed(shared.groupBy("scene", "pred_id", "instance").agg(F.count("*").alias("common"), F.count_if(_ignored(ignore)).alias("void")))
    sizes = hits.groupBy("scene", "pred_id").agg(F.sum("common").alias("psize"), F.sum("void").alias("void"))
    known = preds.where(~F.col("class").isin(*ignore)) if ignore else preds
    found = known.select("scene", "pred_id", "class", "score").join(sizes.where(F.col("psize") >= least), ["scene", "pred_id"])
    true = checkpointed(instances(truth, ignore, ignore_instance))
    edges = hits.drop("void").join(true, ["scene", "instance"]).join(found.drop("void"), ["scene", "pred_id", "class"])
    return true, found, edges.withColumn("overlap", F.col("common") / (F.col("size") + F.col("psize") - F.col("common")))


def uncontested(edges: DataFrame) -> DataFrame:
    """Edges without those to predictions that an earlier instance of the scene has taken.

    edges are of one or more thresholds.  An instance, in order of ids, takes the first prediction that is still free.  Only
    predictions with several instances can be taken from one, so the instances that have such a one are folded by scene, class and
    threshold, and all other edges are left as they are.
    """
    unit = ["scene", "class", "threshold"]
    several = edges.groupBy(*unit, "pred_id").agg(F.count("*").alias("n")).where("n > 1").select(*unit, "pred_id", F.lit(True).alias("several"))
    marked = edges.join(several, [*unit, "pred_id"], "left").select(*unit, "instance", "pred_id", F.coalesce("several", F.lit(False)).alias("several"))
    lists = marked.groupBy(*unit, "instance").agg(F.array_sort(F.collect_list(F.struct("pred_id", "several"))).alias("preds")).where(F.exists("preds", lambda p: p["several"]))
    units = lists.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("instance", "preds"))).alias("all"))
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    none = F.array().cast(f"array<struct<pred_id:{kinds['pred_id']},taker:{kinds['instance']}>>")

    def take(done: Column, x: Column) -> Column:
        free = F.filter(x["preds"], lambda p: ~F.exists(done, lambda d: d["pred_id"] == p["pred_id"]))
        first = F.get(free, F.lit(0))
        return F.when(F.coalesce(first["several"], F.lit(False)), F.concat(done, F.array(F.struct(first["pred_id"].alias("pred_id"), x["instance"].alias("taker"))))).otherwise(done)

    taken = units.select(*unit, F.inline(F.aggregate("all", none, take)))
    return edges.join(taken, [*unit, "pred_id"], "left").where(F.col("taker").isNull() | (F.col("instance") <= F.col("taker"))).drop("taker")


def verdicts(true: DataFrame, found: DataFrame, edges: DataFrame, thresholds: tuple[float, ...] = OVERLAPS, least: int = LEAST_POINTS) -> DataFrame:
    """(class, threshold, score, hit) of the predictions that count: the best of an instance's predictions is a hit, its others are
    false, as are predictions without an instance unless more than the threshold's share of their points is void or of small instances."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    above = edges.withColumn("threshold", F.explode(F.filter(grid, lambda t: F.col("overlap") > t)))
    w = Window.partitionBy("scene", "class", "threshold", "instance").orderBy(F.desc("score"), "pred_id")
    matched = uncontested(above.where(F.col("size") >= least)).withColumn("hit", (F.row_number().over(w) == 1).cast("long")).select("class", "threshold", "score", "hit")
    small = edges.where(F.col("size") < least).groupBy("scene", "pred_id").agg(F.sum("common").alias("small"))
    waste = found.join(small, ["scene", "pred_id"], "left").withColumn("share", (F.col("void") + F.coalesce("small", F.lit(0))) / F.col("psize"))
    each = waste.withColumn("threshold", F.explode(F.filter(grid, lambda t: F.col("share") <= t)))
    false = each.join(above.select("scene", "pred_id", "threshold").distinct(), ["scene", "pred_id", "threshold"], "left_anti")
    return matched.unionByName(false.select("class", "threshold", "score", F.lit(0).cast("long").alias("hit")))


def instance_ap(truth: DataFrame, masks: DataFrame, preds: DataFrame, *, thresholds: tuple[float, ...] = OVERLAPS, ignore: tuple[int, ...] = (-1,), ignore_instance: int = -1, least: int = LEAST_POINTS) -> DataFrame:
    """(class, threshold, instances, hits, ap) for the classes that have instances of at least ``least`` points or predictions.

    truth (scene, point_id, segment, instance): labelled points.  masks (scene, pred_id, point_id): the points of each prediction, which
    may overlap.  preds (scene, pred_id, class, score).  ap is the area below the precision by recall, by trapezoids between
    the distinct scores, ending at precision 1 and recall 0; null for a class without instances, 0 for one without predictions.
    """
    true, found, edges = overlaps(truth, masks, preds, ignore=ignore, ignore_instance=ignore_instance, least=least)
    counts = verdicts(true, found, edges, thresholds, least).groupBy("class", "threshold", "score").agg(F.count("*").alias("n"), F.sum("hit").alias("hit"))
    curve = running(counts, ["class", "threshold"], ["score"], ("n", "hit"), name="at")
    totals = curve.groupBy("class", "threshold").agg(F.sum("n").alias("all"), F.sum("hit").alias("hits"))
    large = true.where(F.col("size") >= least).groupBy("class").agg(F.count("*").alias("instances"))
    # every instance is hit once or missed
    totals = checkpointed(totals)
    curve = with_groups(curve, totals.join(large, "class"), ["class", "threshold"])
    precision = (F.col("hits") - F.col("hit_before")) / (F.col("all") - F.col("n_before"))
    left = F.col("all") - F.col("n_before") - F.col("n")
    onward = F.when(left > 0, (F.col("hits") - F.col("hit_before") - F.col("hit")) / F.when(left > 0, left)).otherwise(1.0)
    area = curve.groupBy("class", "threshold").agg(F.sum(F.col("hit") / F.col("instances") * (precision + onward) / 2).alias("area"))
    classes = large.join(found.select("class").distinct(), "class", "full_outer")
    grid = classes.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    out = grid.join(area, ["class", "threshold"], "left").join(totals.select("class", "threshold", "hits"), ["class", "threshold"], "left")
    ap = F.when(F.col("instances").isNotNull(), F.coalesce("area", F.lit(0.0)))
    return out.select("class", "threshold", F.coalesce("instances", F.lit(0).cast("long")).alias("instances"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), ap.alias("ap"))


def ap_summary(ap: DataFrame) -> DataFrame:
    """(class, ap, ap50, ap25): means over all thresholds but 0.25, at 0.5 and at 0.25; class null is the mean over classes that have any."""
    at = lambda cond: F.avg(F.when(cond, F.col("ap")))
    t = F.col("threshold")
    return ap.groupingSets([[F.col("class")], []], F.col("class")).agg(at(F.abs(t - 0.25) > 1e-9).alias("ap"), at(F.abs(t - 0.5) < 1e-9).alias("ap50"), at(F.abs(t - 0.25) < 1e-9).alias("ap25"))
