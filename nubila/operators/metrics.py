"""Recall, segmentation and instance metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running, with_groups


def set_recall(exact: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per query: distinct true neighbours found, their share of k, and repeated slots of the prediction."""
    truth = exact.groupBy("query_id").agg(F.count("*").alias("k"))
    hit = predicted.select("query_id", "support_id").distinct().join(exact.select("query_id", "support_id"), ["query_id", "support_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    slots = predicted.groupBy("query_id").agg((F.count("*") - F.count_distinct("support_id")).alias("repeated"))
    out = truth.join(hit, "query_id", "left").join(slots, "query_id", "left")
    return out.select("query_id", "k", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("k")).alias("recall"), F.coalesce("repeated", F.lit(0)).alias("repeated"))


def recall_summary(recalls: DataFrame) -> DataFrame:
    p = lambda q: F.percentile("recall", F.lit(q))
    return recalls.agg(F.count("*").alias("queries"), F.avg("recall").alias("mean"), F.min("recall").alias("minimum"), p(0.01).alias("p01"), p(0.05).alias("p05"), F.sum("repeated").alias("duplicate_slots"), F.count_if(F.col("repeated") > 0).alias("duplicate_queries"))


def coverage(exact: DataFrame, ball: DataFrame, k: int, radius: float) -> DataFrame:
    """Shares of filled slots, of queries whose k-th neighbour lies outside, and of queries whose (k+1)-th lies inside.

    exact must hold k+1 ranks.
    """
    kth = exact.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("d2"))).alias("dk"), F.max(F.when(F.col("rank") == k + 1, F.col("d2"))).alias("dn"))
    filled = ball.groupBy("query_id").agg(F.count("*").alias("n"))
    r2 = F.lit(radius * radius)
    return kth.join(filled, "query_id", "left").agg(
        (F.sum(F.coalesce("n", F.lit(0))) / (F.count("*") * k)).alias("valid"),
        F.avg(F.when(F.col("dk") >= r2, 1.0).otherwise(0.0)).alias("insufficient"),
        F.avg(F.when(F.col("dn") < r2, 1.0).otherwise(0.0)).alias("truncated"),
    )


def confusion(seg: DataFrame, classes: int, target: str = "target", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of (target, pred); without ``by`` every pair of classes has a row."""
    inside = seg.where(F.col(target).between(0, classes - 1) & F.col(pred).between(0, classes - 1))
    counts = inside.groupBy(*by, F.col(target).cast("int").alias("target"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    if by:
        return counts
    each = seg.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("target"), (F.col("id") % classes).cast("int").alias("pred"))
    return F.broadcast(each).join(counts, ["target", "pred"], "left").select("target", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_areas(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per class (and group): intersection, target and predicted areas, union."""
    each = counts.select(*by, "n", F.explode(F.array(F.struct(F.col("target").alias("class"), F.lit("t").alias("side")), F.struct(F.col("pred").alias("class"), F.lit("p").alias("side")))).alias("c"), "target", "pred")
    add = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    t, p = F.col("c.side") == "t", F.col("c.side") == "p"
    out = each.groupBy(*by, F.col("c.class").alias("class")).agg(add(t & (F.col("target") == F.col("pred"))).alias("intersection"), add(t).alias("target_area"), add(p).alias("pred_area"))
    return out.withColumn("union", F.col("target_area") + F.col("pred_area") - F.col("intersection"))


def iou(areas: DataFrame, mode: str = "nan", by: tuple[str, ...] = ()) -> DataFrame:
    """Per class IoU and accuracy; mode nan leaves classes without area null, eps adds 1e-10 below, clamp divides by 1 at least."""
    i, u, t = (F.col(c).cast("double") for c in ("intersection", "union", "target_area"))
    if mode == "nan":
        value, acc = F.when(u > 0, i / F.when(u > 0, u)), F.when(t > 0, i / F.when(t > 0, t))
    elif mode == "eps":
        value, acc = i / (u + 1e-10), i / (t + 1e-10)
    elif mode == "clamp":
        value, acc = i / F.greatest(u, F.lit(1.0)), i / F.greatest(t, F.lit(1.0))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return areas.select(*by, "class", value.alias("iou"), acc.alias("accuracy"))


def mean_iou(areas: DataFrame, mode: str = "nan") -> DataFrame:
    per = iou(areas, mode).agg(F.avg("iou").alias("miou"), F.avg("accuracy").alias("macc"))
    total = areas.agg((F.sum("intersection") / F.sum("target_area")).alias("overall"))
    return per.join(F.broadcast(total))


def fold_rollup(seg: DataFrame, fold: str = "fold") -> DataFrame:
    """Areas of each class by fold and, with a null fold, over all folds."""
    each = seg.select(F.col(fold).alias("fold"), "target", "pred", F.explode(F.array_distinct(F.array("target", "pred"))).alias("class"))
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    t, p = F.col("target") == F.col("class"), F.col("pred") == F.col("class")
    return each.groupingSets([[F.col("fold"), F.col("class")], [F.col("class")]], F.col("fold"), F.col("class")).agg(one(t & p).alias("intersection"), one(t | p).alias("union"), one(t).alias("target_area"))


def boundary(nbrs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(point_id, same, is_boundary): the share of a point's neighbours of its own label, and whether it is below ``least``."""
    own = labels.select(F.col("point_id").alias("query_id"), F.col("label").alias("ql"))
    near = labels.select(F.col("point_id").alias("support_id"), F.col("label").alias("sl"))
    share = nbrs.join(own, "query_id").join(near, "support_id").groupBy("query_id").agg(F.avg(F.when(F.col("ql") == F.col("sl"), 1.0).otherwise(0.0)).alias("same"))
    return share.select(F.col("query_id").alias("point_id"), "same", (F.col("same") < least).alias("is_boundary"))


def vote(probs: DataFrame) -> DataFrame:
    """The class of the largest summed probability of each point, the smallest class among equals."""
    total = probs.groupBy("point_id", "class").agg(F.round(F.sum("prob"), 9).alias("p"))
    return total.groupBy("point_id").agg(F.min_by("class", F.struct(-F.col("p"), "class")).alias("pred"), F.max("p").alias("votes"))


def part_iou(seg: DataFrame, parts: int) -> DataFrame:
    """Mean part IoU of each shape; a part that neither side has counts as 1."""
    areas = class_areas(seg.groupBy("shape", F.col("target").alias("target"), F.col("pred").alias("pred")).agg(F.count("*").alias("n")), ("shape",))
    per = areas.where(F.col("class").between(0, parts - 1)).groupBy("shape").agg(F.sum(F.col("intersection") / F.col("union")).alias("s"), F.count("*").alias("present"))
    return per.select("shape", ((F.col("s") + (parts - F.col("present"))) / parts).alias("iou"))


def lovasz(probs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per class the Lovász extension of the Jaccard loss: errors sorted downwards, dotted with differences of the Jaccard index.

    probs (point_id, class, prob), labels (point_id, label).
    """
    e = probs.join(labels.select("point_id", "label"), "point_id")
    fg = F.when(F.col("label") == F.col("class"), 1).otherwise(0).cast("long")
    e = e.select("class", "point_id", fg.alias("fg"), F.abs(fg - F.col("prob")).alias("err"))
    placed = running(e, ["class"], ["-err", "point_id"], ("fg",), name="rn")
    placed = with_groups(placed, e.groupBy("class").agg(F.sum("fg").alias("g")).where("g > 0"), ["class"])
    # the index before and after a row, from the rows of the class and the others so far
    index = lambda hits, rows: 1 - (F.col("g") - hits) / (F.col("g") + rows - hits)
    step = index(F.col("fg_before") + F.col("fg"), F.col("rn") + 1) - index(F.col("fg_before"), F.col("rn"))
    return placed.groupBy("class").agg(F.sum(F.col("err") * step).alias("loss"))


def class_weights(labels: DataFrame) -> DataFrame:
    """1 / (frequency + 0.02), divided by the mean."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row per class
    raw = counts.withColumn("w", 1 / (F.col("n") / F.sum("n").over(w) + 0.02))
    return raw.select("label", (F.col("w") / F.avg("w").over(w)).alias("weight"))


def average_precision(matches: DataFrame) -> DataFrame:
    """Average precision by (class, threshold) from (class, threshold, pred_id, gt_id, iou, score, n_gt).

    Predictions are taken by falling score (ties by id); each takes the free instance with the largest overlap above the threshold.
    Greedy matching is sequential within a class and threshold, so these are the units of work.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        taken, flags = set(), []
        pdf = pdf.assign(_s=-pdf["score"])
        for _, group in pdf.sort_values(["_s", "pred_id", "iou"], ascending=[True, True, False]).groupby(["_s", "pred_id"], sort=True):
            good = [g for g, v in zip(group["gt_id"], group["iou"]) if pd.notna(g) and v > key[1] and g not in taken]
            taken.update(good[:1])
            flags.append(bool(good))
        n, ap, hits, best = float(pdf["n_gt"].iloc[0]), 0.0, 0, []
        for i, f in enumerate(flags, 1):
            hits += f
            best.append((hits / n if n else 0.0, hits / i))
        last = 0.0
        for i, (recall, _) in enumerate(best):
            ap += (recall - last) * max(p for _, p in best[i:])
            last = recall
        return pd.DataFrame({"class": [key[0]], "threshold": [key[1]], "ap": [ap]})

    return matches.groupBy("class", "threshold").applyInPandas(run, "class int, threshold double, ap double")


def pooled_recall(exact: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """Matches of all queries over their valid slots, and the share of the k slots of each query that are valid."""
    same = predicted.join(exact.select("query_id", "support_id"), ["query_id", "support_id"], "left_semi").agg(F.count("*").alias("matches"))
    slots = predicted.agg(F.count("*").alias("valid"))
    queries = exact.agg(F.count_distinct("query_id").alias("queries"))
    # three single rows
    return same.crossJoin(slots).crossJoin(queries).select((F.col("matches") / F.col("valid")).alias("recall"), (F.col("valid") / (F.col("queries") * k)).alias("valid_fraction"))


def boundary_histogram(shares: DataFrame, bins: int = 100) -> DataFrame:
    """Points by the share of neighbours of their own class, in bins + 1 bins (bin i from i / bins on)."""
    return shares.groupBy(F.floor(F.col("same") * bins).alias("bin")).agg(F.count("*").alias("points"))


def subset_metrics(seg: DataFrame, classes: int, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(by, subset, points, miou, macc, overall) of all, boundary and inner points from (by, target, pred, is_boundary).

    Classes that neither side has are left out of the means.  One aggregation of the points; the rest is a row per class pair.
    """
    names = F.array(F.lit("all"), F.when(F.col("is_boundary"), "boundary").otherwise("inner"))
    counts = confusion(seg.withColumn("subset", F.explode(names)), classes, by=(*by, "subset"))
    areas = class_areas(counts, (*by, "subset"))
    per = iou(areas, "nan", (*by, "subset")).groupBy(*by, "subset").agg(F.avg("iou").alias("miou"), F.avg("accuracy").alias("macc"))
    total = areas.groupBy(*by, "subset").agg(F.sum("target_area").alias("points"), (F.sum("intersection") / F.sum("target_area")).alias("overall"))
    return total.join(per, [*by, "subset"]).select(*by, "subset", "points", "miou", "macc", "overall")


def band_recalls(candidates: DataFrame, fixed: DataFrame, adaptive: DataFrame, k: int, low: int = 2, high: int = 8) -> DataFrame:
    """(band, queries, share, fixed_recall, adaptive_recall, gain) by the number of candidates of a query: below low * k, within, above high * k.

    candidates (query_id, candidates); fixed and adaptive (query_id, recall) of the same queries.
    """
    band = F.when(F.col("candidates") < low * k, "below").when(F.col("candidates") <= high * k, "within").otherwise("above")
    side = lambda df, n: df.select("query_id", F.col("recall").alias(n))
    each = candidates.select("query_id", band.alias("band")).join(side(fixed, "f"), "query_id").join(side(adaptive, "a"), "query_id")
    out = each.groupBy("band").agg(F.count("*").alias("queries"), F.avg("f").alias("fixed_recall"), F.avg("a").alias("adaptive_recall"))
    # three rows
    total = out.agg(F.sum("queries").alias("__all"))
    return out.join(F.broadcast(total), F.lit(True)).select("band", "queries", (F.col("queries") / F.col("__all")).alias("share"), "fixed_recall", "adaptive_recall", (F.col("adaptive_recall") - F.col("fixed_recall")).alias("gain"))


def part_iou_summary(shapes: DataFrame, category: str = "category") -> DataFrame:
    """(category, shapes, iou) from (shape, category, iou): the mean of each category's shapes; category null is the mean over all shapes
    and, as class_iou, over the categories' means."""
    per = shapes.groupBy(category).agg(F.count("*").alias("shapes"), F.avg("iou").alias("iou"))
    every = per.agg(F.lit(None).cast(shapes.schema[category].dataType).alias(category), F.sum("shapes").alias("shapes"), (F.sum(F.col("iou") * F.col("shapes")) / F.sum("shapes")).alias("iou"), F.avg("iou").alias("class_iou"))
    return per.withColumn("class_iou", F.lit(None).cast("double")).unionByName(every)
