"""Analysis of benchmark records: grouped, pivoted, paired, binned and with confidence intervals."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def t_quantile(df: int) -> float:
    """The 0.975 quantile of Student's t, by bisection on its distribution function."""

    def below(t: float) -> float:
        # Simpson's rule on the density over [0, t]
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        n = 2000
        h = t / n
        f = [c * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
        return 0.5 + h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))

    lo, hi = 0.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < 0.975 else (lo, mid)
    return lo


def t_column(df: Column, known: int = 30) -> Column:
    """Quantiles for df 1..known from a map, an expansion around the normal one above."""
    table = F.create_map(*chain.from_iterable((F.lit(i), F.lit(round(t_quantile(i), 6) if i > 1 else 12.706205)) for i in range(1, known + 1)))
    z = 1.959963984540054
    n = df.cast("double")
    far = F.lit(z) + (z**3 + z) / 4 / n + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (n * n)
    return F.when(df <= known, F.try_element_at(table, df.cast("int"))).otherwise(far)


def main_table(records: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def pivot_table(records: DataFrame, index: tuple[str, ...], values: tuple[str, ...], modes: tuple[str, ...], ks: tuple[int, ...]) -> DataFrame:
    """Metrics as rows, (mode, k) as columns, means as values; the columns are given, so no extra job looks for them."""
    long = records.unpivot([*index, "mode", "k"], list(values), "metric", "value")
    long = long.withColumn("cell", F.concat_ws("_", "mode", F.col("k").cast("string")))
    return long.groupBy(*index, "metric").pivot("cell", [f"{m}_{k}" for m in modes for k in ks]).agg(F.avg("value"))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL engines with IEEE division have it: by zero infinite, zero by zero NaN."""
    return F.when(b == 0, F.signum(a) * F.lit(float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0)))


def rounded(c: Column, digits: int) -> Column:
    """c to so many digits as SQL engines that scale doubles have it; F.round goes by the shortest decimal and differs at halves."""
    by = F.lit(float(10**digits))
    out = F.round(c * by) / by
    return F.when(F.abs(out) < float("inf"), out).otherwise(c)


def speedups(records: DataFrame, baseline: str, keys: tuple[str, ...] = ("room", "mode", "k"), value: str = "query_ms", order: str | None = None) -> DataFrame:
    """Mean time of each method and its ratio to the baseline's under the same keys.

    With ``order`` a group's times are added up in that order: sums of doubles depend on it in their last digits, and rounded ratios
    at halves show it.
    """
    if order is None:
        means = records.groupBy(*keys, "method").agg(F.avg(value).alias("ms"))
    else:
        w = Window.partitionBy(*keys, "method").orderBy(order, value)
        each = records.select(*keys, "method", F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("ms"), F.row_number().over(w).alias("__nth"))
        means = each.where("__nth = 1").drop("__nth")
    base = means.where(F.col("method") == baseline).select(*keys, F.col("ms").alias("base_ms"))
    return means.join(base, list(keys), "left").select(*keys, "method", "ms", ratio(F.col("base_ms"), F.col("ms")).alias("speedup"))


#: Upper ends of the size bins, in points.
BINS = (("<=250k", 250_000), ("250k-500k", 500_000), ("500k-1M", 1_000_000), ("1M-2M", 2_000_000))


def size_bin(n: Column, bins=BINS) -> Column:
    out = F.lit(f">{bins[-1][0].split('-')[-1]}")
    for name, top in reversed(bins):
        out = F.when(n <= top, name).otherwise(out)
    return out


def binned(records: DataFrame, sizes: DataFrame, baseline: str) -> DataFrame:
    """By size bin and method: rooms, mean time, million queries a second, and the mean of the rooms' speedups."""
    means = records.groupBy("room", "method").agg(F.avg("query_ms").alias("ms"))
    base = means.where(F.col("method") == baseline).select("room", F.col("ms").alias("base_ms"))
    each = means.join(base, "room").join(sizes, "room").withColumn("bin", size_bin(F.col("num_support")))
    return each.groupBy("bin", "method").agg(F.count("*").alias("rooms"), F.avg("ms").alias("mean_ms"), F.avg(ratio(F.col("num_support").cast("double"), F.col("ms")) / 1000).alias("mquery_s"), F.avg(ratio(F.col("base_ms"), F.col("ms"))).alias("speedup"))


def statistics(records: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """n, mean, sample deviation, half width of the 95 % interval, median, p95, least and largest."""
    out = records.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.withColumn("ci95", F.when(F.col("n") > 1, t_column(F.col("n") - 1) * F.col("sd") / F.sqrt("n")))


def nearest_rank(records: DataFrame, keys: tuple[str, ...], value: str, share: float = 0.95) -> DataFrame:
    """The value at rank round(share * (n-1)), half to even."""
    w = Window.partitionBy(*keys)
    ranked = records.withColumns({"rn": F.row_number().over(w.orderBy(value)) - 1, "n": F.count("*").over(w)})
    return ranked.where(F.col("rn") == F.bround(F.lit(share) * (F.col("n") - 1))).select(*keys, F.col(value).alias(f"p{round(100 * share)}"))


def median_of_medians(records: DataFrame, keys: tuple[str, ...], value: str, inner: str = "room") -> DataFrame:
    per = records.groupBy(*keys, inner).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    return per.groupBy(*keys).agg(F.percentile("m", F.lit(0.5)).alias("median"))


def nearest_sizes(sizes: DataFrame, targets: tuple[int, ...]) -> DataFrame:
    """For each target the room whose size is nearest, the smallest room among equals."""
    each = sizes.select("room", "num_support", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    return each.groupBy("target").agg(F.min_by(F.struct("room", "num_support"), F.struct(F.abs(F.col("num_support") - F.col("target")), "room")).alias("r")).select("target", "r.room", "r.num_support")


def moving(records: DataFrame, value: str, window: int, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Latest value, mean and median of the last ``window`` rows, and the mean of all rows so far, in order."""
    w = Window.partitionBy(*by).orderBy(order)
    last = w.rowsBetween(-window + 1, 0)
    return records.select(*by, order, F.col(value).alias("latest"), F.avg(value).over(last).alias("window_mean"), F.percentile(value, F.lit(0.5)).over(last).alias("window_median"), F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("global_mean"))


def merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old with the rows of new whose keys it lacks; equal records are skipped; a conflicting one, or a key that one side has twice, is an error."""
    for side in (old, new):
        twice = side.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"several records for {[twice[0][k] for k in keys]}")
    values = [c for c in old.columns if c not in keys]
    both = old.join(new.select(*keys, F.struct(*values).alias("__new")), list(keys))
    ok = both.where(~F.struct(*values).eqNullSafe(F.col("__new")))
    bad = ok.limit(1).collect()
    if bad:
        raise ValueError(f"conflicting record for {[bad[0][k] for k in keys]}")
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def remaining(todo: DataFrame, complete: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(complete.select(*keys).distinct(), list(keys), "left_anti")


def multiset_common(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys of both with how often both have them (repeated records count as often as the side that has fewer); null keys are keys."""
    return left.select(*keys).intersectAll(right.select(*keys)).groupBy(*keys).agg(F.count("*").alias("common"))


def key_differences(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that one side lacks: side is missing (only left has it) or extra (only right has it); null keys are keys."""
    a, b = left.select(*keys), right.select(*keys)
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


def lacking(records: DataFrame, column: str, required: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """(by, column) of the required values that a group has no record of; records without a group are one."""
    wanted = records.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, required))).alias(column))
    return wanted.subtract(records.select(*by, column))


def identity_mismatches(left: DataFrame, right: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Keys that one side lacks or whose fields differ; reason is left, right (the side that has it) or fields.  Null keys are keys."""
    a, b = (d.select(*[F.col(k).alias(f"{n}_{k}") for k in keys], F.struct(*fields).alias(n)) for d, n in ((left, "a"), (right, "b")))
    on = None
    for k in keys:
        same = F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        on = same if on is None else on & same
    reason = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(~F.col("a").eqNullSafe(F.col("b")), "fields")
    return a.join(b, on, "full").select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], reason.alias("reason")).where("reason is not null")


def cyclic_order(rooms: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """(room, position, variant): each room runs all variants, starting one further than the room before it."""
    v = F.array(*map(F.lit, variants))
    # rooms are few: one row each
    ranked = rooms.select("room").distinct().withColumn("rank", F.row_number().over(Window.orderBy("room")) - 1)
    each = ranked.select("room", "rank", F.explode(F.sequence(F.lit(0), F.lit(len(variants) - 1))).alias("position"))
    return each.select("room", "position", F.element_at(v, (F.pmod(F.col("rank") + F.col("position"), F.lit(len(variants))) + 1).cast("int")).alias("variant"))
