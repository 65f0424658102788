"""Point transforms by name, and pipelines of them from configuration.

Random parameters come from a seeded hash of the batch, so a plan gives the same result each time it runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import with_groups

REGISTRY: dict[str, Callable] = {}


def with_cloud(df: DataFrame, **values: Column) -> tuple[DataFrame, list[str]]:
    """df with aggregates of each row's cloud as further columns, and these columns' names.

    The clouds' rows are combined in the map tasks; their aggregates are counted, and sent to every task unless they are very many.
    """
    own = [f"__cloud_{k}" for k in values]
    small = df.groupBy("batch").agg(*[v.alias(n) for n, v in zip(own, values.values())])
    return with_groups(df, small, ["batch"]), own


def box(names: tuple[str, ...]) -> dict[str, Column]:
    """Least and greatest values of columns: lo_name and hi_name."""
    return {f"{k}_{n}": f(n) for n in names for k, f in (("lo", F.min), ("hi", F.max))}


def register(f: Callable) -> Callable:
    REGISTRY[f.__name__] = f
    return f


def uniform(seed: int, low: float = 0.0, high: float = 1.0, by: str = "batch", salt: int = 0) -> Column:
    """One uniform number per value of ``by``."""
    h = F.pmod(F.xxhash64(F.col(by), F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return h * (high - low) + low


def normal(seed: int, salt: int) -> Column:
    """A standard normal number per point (Box-Muller)."""
    u, v = (uniform(seed, by="point_id", salt=2 * salt + i) for i in (0, 1))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def xyz(f: Callable[[str], Column]) -> dict[str, Column]:
    return {a: f(a) for a in "xyz"}


@register
def positive_shift(df: DataFrame) -> DataFrame:
    out, own = with_cloud(df, **{a: F.min(a) for a in "xyz"})
    return out.withColumns(xyz(lambda a: F.col(a) - F.col(f"__cloud_{a}"))).drop(*own)


@register
def center_shift(df: DataFrame, apply_z: bool = True) -> DataFrame:
    out, own = with_cloud(df, **box(("x", "y", "z")))
    mid = lambda a: (F.col(f"__cloud_lo_{a}") + F.col(f"__cloud_hi_{a}")) / 2
    return out.withColumns({"x": F.col("x") - mid("x"), "y": F.col("y") - mid("y"), "z": F.col("z") - F.col("__cloud_lo_z") if apply_z else F.col("z")}).drop(*own)


@register
def normalize_coord(df: DataFrame) -> DataFrame:
    out, own = with_cloud(df, **{a: F.avg(a) for a in "xyz"})
    out = out.withColumns(xyz(lambda a: F.col(a) - F.col(f"__cloud_{a}"))).drop(*own)
    out, own = with_cloud(out, m=F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))))
    return out.withColumns(xyz(lambda a: F.col(a) / F.col("__cloud_m"))).drop(*own)


@register
def normalize_color(df: DataFrame, columns: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    return df.withColumns({c: F.col(c) / 127.5 - 1 for c in columns})


@register
def point_clip(df: DataFrame, box: tuple[float, ...] = (-80, -80, -3, 80, 80, 1)) -> DataFrame:
    return df.withColumns({a: F.greatest(F.least(F.col(a), F.lit(float(box[i + 3]))), F.lit(float(box[i]))) for i, a in enumerate("xyz")})


@register
def random_shift(df: DataFrame, shift: tuple = ((-0.2, 0.2), (-0.2, 0.2), (0, 0)), seed: int = 0) -> DataFrame:
    return df.withColumns({a: F.col(a) + uniform(seed, *shift[i], salt=i) for i, a in enumerate("xyz")})


@register
def random_scale(df: DataFrame, scale: tuple[float, float] = (0.95, 1.05), anisotropic: bool = False, seed: int = 0) -> DataFrame:
    return df.withColumns({a: F.col(a) * uniform(seed, *scale, salt=i if anisotropic else 0) for i, a in enumerate("xyz")})


@register
def random_flip(df: DataFrame, p: float = 0.5, seed: int = 0) -> DataFrame:
    out = {}
    for i, a in enumerate("xy"):
        flip = uniform(seed, salt=i) < p
        for c in (a, f"n{a}"):
            if c in df.columns:
                out[c] = F.when(flip, -F.col(c)).otherwise(F.col(c))
    return df.withColumns(out)


def rotated(df: DataFrame, angle: Column, axis: str = "z", center: bool = True) -> DataFrame:
    """Rotate points (around the middle of their cloud's box) and normals by an angle."""
    a, b = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[axis]
    c, s = F.cos(angle), F.sin(angle)
    out, own = {}, []
    if center:
        df, own = with_cloud(df, **box((a, b)))
    for p, q, mid in ((a, b, center), (f"n{a}", f"n{b}", False)):
        if p in df.columns and q in df.columns:
            m = [(F.col(f"__cloud_lo_{v}") + F.col(f"__cloud_hi_{v}")) / 2 if mid else F.lit(0.0) for v in (p, q)]
            u, v = F.col(p) - m[0], F.col(q) - m[1]
            out |= {p: u * c - v * s + m[0], q: u * s + v * c + m[1]}
    return df.withColumns(out).drop(*own)


@register
def rotate(df: DataFrame, angle: float, axis: str = "z", center: bool = True) -> DataFrame:
    return rotated(df, F.lit(float(angle)), axis, center)


@register
def random_rotate(df: DataFrame, angle: tuple[float, float] = (-1, 1), axis: str = "z", seed: int = 0, p: float = 1.0) -> DataFrame:
    turn = F.when(uniform(seed, salt=9) < p, uniform(seed, *angle) * math.pi).otherwise(0.0)
    return rotated(df, turn, axis)


@register
def random_rotate_target_angle(df: DataFrame, angle: tuple[float, ...] = (0.5, 1, 1.5), axis: str = "z", seed: int = 0, p: float = 0.75) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in angle]), (F.floor(uniform(seed, 0, len(angle))) + 1).cast("int")) * math.pi
    return rotated(df, F.when(uniform(seed, salt=9) < p, pick).otherwise(0.0), axis)


@register
def random_jitter(df: DataFrame, sigma: float = 0.01, clip: float = 0.05, seed: int = 0) -> DataFrame:
    return df.withColumns({a: F.col(a) + F.greatest(F.least(normal(seed, i) * sigma, F.lit(clip)), F.lit(-clip)) for i, a in enumerate("xyz")})


@register
def clip_gaussian_jitter(df: DataFrame, scalar: float = 0.02, seed: int = 0) -> DataFrame:
    return df.withColumns({a: F.col(a) + F.greatest(F.least(normal(seed, i) / 1.96, F.lit(1.0)), F.lit(-1.0)) * scalar for i, a in enumerate("xyz")})


def clipped(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(255.0)), F.lit(0.0))


@register
def chromatic_auto_contrast(df: DataFrame, blend: float = 0.5) -> DataFrame:
    df, own = with_cloud(df, **box(("r", "g", "b")))
    lo, hi = (lambda c: F.col(f"__cloud_lo_{c}")), (lambda c: F.col(f"__cloud_hi_{c}"))
    stretch = lambda c: (F.col(c) - lo(c)) * 255 / F.when(hi(c) > lo(c), hi(c) - lo(c)).otherwise(1)
    return df.withColumns({c: F.col(c) * (1 - blend) + stretch(c) * blend for c in "rgb"}).drop(*own)


@register
def chromatic_translation(df: DataFrame, ratio: float = 0.05, seed: int = 0) -> DataFrame:
    return df.withColumns({c: clipped(F.col(c) + (uniform(seed, salt=i) - 0.5) * 255 * 2 * ratio) for i, c in enumerate("rgb")})


@register
def chromatic_jitter(df: DataFrame, std: float = 0.005, seed: int = 0) -> DataFrame:
    return df.withColumns({c: clipped(F.col(c) + normal(seed, i) * std * 255) for i, c in enumerate("rgb")})


#: Luma weights of red, green and blue (fixed values).
LUMA = (0.2989, 0.587, 0.114)


def gray() -> Column:
    return F.col("r") * LUMA[0] + F.col("g") * LUMA[1] + F.col("b") * LUMA[2]


@register
def color_gray_scale(df: DataFrame) -> DataFrame:
    return df.withColumn("__g", gray()).withColumns({c: F.col("__g") for c in "rgb"}).drop("__g")


@register
def adjust_color(df: DataFrame, brightness: float = 1.0, contrast: float = 1.0, saturation: float = 1.0, hue: float = 0.0) -> DataFrame:
    """Blend with black, with the cloud's mean gray, with gray, and turn the hue."""
    df = df.withColumns({c: clipped(F.col(c) * brightness) for c in "rgb"})
    df, _ = with_cloud(df, g=F.avg(gray()))
    df = df.withColumns({c: clipped(F.col(c) * contrast + F.col("__cloud_g") * (1 - contrast)) for c in "rgb"}).drop("__cloud_g")
    df = df.withColumn("__g", gray()).withColumns({c: clipped(F.col(c) * saturation + F.col("__g") * (1 - saturation)) for c in "rgb"}).drop("__g")
    return hue_saturation(df, hue, 1.0) if hue else df


#: What random_color_jitter() does, in the order of its numbers 0 to 3.
JITTERS = ("brightness", "contrast", "saturation", "hue")


def jitter_plan(seed: int, ranges: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Columns of a cloud's draws: each operation's factor and its place 0..3 in the cloud's own order, from a scramble of the batch."""
    draw = lambda salt: scrambled(F.col("batch"), seed * 16 + salt)
    out = {f"__f{i}": ranges[n][0] + (ranges[n][1] - ranges[n][0]) * (draw(i) / float(1 << 31)) for i, n in enumerate(JITTERS)}
    # the place of an operation: how many have a lesser draw, those before it among equals
    key = [draw(8 + i) for i in range(4)]
    for i in range(4):
        before = [((key[j] < key[i]) | ((key[j] == key[i]) & F.lit(j < i))).cast("int") for j in range(4) if j != i]
        out[f"__p{i}"] = before[0] + before[1] + before[2]
    return out


def scrambled(c: Column, salt: int) -> Column:
    """A fixed arithmetic scramble of whole numbers to 0..2**31-1 that SQL engines share."""
    # fixed values: factors of the scramble
    x = F.pmod(c * 7919 + F.lit(salt * 104729 + 12345), F.lit(1 << 31))
    for _ in range(3):
        x = (F.pmod(x, F.lit(1 << 31)) * 1103515245 + 12345) % (1 << 31)
        x = x.bitwiseXOR(F.shiftright(x, 15))
    return x % (1 << 31)


@register
def random_color_jitter(df: DataFrame, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0, hue: float = 0.0, p: float = 1.0, seed: int = 0) -> DataFrame:
    """Brightness, contrast, saturation and hue by random factors, in a random order of each cloud's own; the four don't commute.

    Factors lie in 1 +- the given width (0 at least), hue turns by up to +-hue (0.5 at most); a width of 0 leaves its operation out.  A share p of the
    clouds is changed.  Colours stay within 0 to 255.  Contrast blends with the mean gray that the cloud has when its turn comes.
    A cloud has one such turn, so all clouds are averaged in one pass, each after what precedes its own contrast; clouds go through all
    places side by side.
    """
    widths = {"brightness": brightness, "contrast": contrast, "saturation": saturation, "hue": hue}
    if min(widths.values()) < 0 or hue > 0.5:
        raise ValueError("widths must not be negative, and hue at most 0.5")
    ranges = {n: (-w, w) if n == "hue" else (max(0.0, 1 - w), 1 + w) for n, w in widths.items()}
    columns = df.columns
    df = df.withColumns(jitter_plan(seed, ranges) | {"__on": scrambled(F.col("batch"), seed * 16 + 15) / float(1 << 31) < p})
    rest = [c for c in ("h", "s", "v") if c in columns]
    if hue > 0 and rest:
        raise ValueError(f"columns {rest} are in the way of hue and saturation")
    blend = lambda c, with_, i: clipped(F.col(c) * F.col(f"__f{i}") + with_ * (1 - F.col(f"__f{i}")))

    def applied(df: DataFrame, place: int, mean: Column | None) -> DataFrame:
        """The operation whose turn it is; without ``mean`` only where contrast is yet to come."""
        on = F.col("__on") if mean is not None else F.col("__on") & (F.col("__p1") > place)
        turn = lambda i: on & (F.col(f"__p{i}") == place) & F.lit(widths[JITTERS[i]] > 0)
        df = df.withColumn("__g", gray())
        changed = {}
        for c in "rgb":
            new = F.when(turn(0), blend(c, F.lit(0.0), 0))
            if mean is not None:
                new = new.when(turn(1), blend(c, mean, 1))
            changed[c] = new.when(turn(2), blend(c, F.col("__g"), 2)).otherwise(F.col(c))
        df = df.withColumns(changed).drop("__g")
        if hue > 0:
            kept = {f"__{c}": F.col(c) for c in "rgb"}
            df = rgb_to_hsv(df.withColumns(kept))
            df = hsv_to_rgb(df.withColumn("h", F.pmod(F.col("h") + F.when(turn(3), F.col("__f3")).otherwise(0.0), F.lit(1.0)))).drop("h", "s", "v")
            df = df.withColumns({c: F.when(turn(3), F.col(c)).otherwise(F.col(f"__{c}")) for c in "rgb"}).drop(*kept)
        return df

    mean = F.lit(0.0)
    if contrast > 0:
        before = df
        for place in range(3):
            before = applied(before, place, None)
        own = before.groupBy("batch").agg(F.avg(gray()).alias("__cloud_g"))
        df, mean = with_groups(df, own, ["batch"]), F.col("__cloud_g")
    for place in range(4):
        df = applied(df, place, mean)
    return df.select(*columns)


@register
def room_augmentation(df: DataFrame, seed: int = 0, jitter: float = 0.005, scale: tuple[float, float] = (0.8, 1.2), drop: float = 0.2, contrast: float = 0.2) -> DataFrame:
    """Turn each cloud about the z axis and scale it at random, jitter its points and move it to its least corner; blacken the colours of a
    share ``drop`` of clouds, stretch those of a share ``contrast`` of the others by a random blend, and divide them by 250; add ``height``."""
    draw = lambda i: scrambled(F.col("batch"), seed * 16 + i) / float(1 << 31)
    columns = df.columns
    df = df.withColumns({"__a": draw(0) * (2 * math.pi), "__s": draw(1) * (scale[1] - scale[0]) + scale[0], "__k": draw(2), "__c": draw(3), "__b": draw(4)})
    c, s = F.cos("__a") * F.col("__s"), F.sin("__a") * F.col("__s")
    df = df.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c, "z": F.col("z") * F.col("__s")})
    if jitter:
        df = df.withColumns({a: F.col(a) + normal(seed, i) * jitter for i, a in enumerate("xyz")})
    df, own = with_cloud(df, **{a: F.min(a) for a in "xyz"}, **box(("r", "g", "b")))
    low, high = (lambda v: F.col(f"__cloud_lo_{v}")), (lambda v: F.col(f"__cloud_hi_{v}"))
    wide = lambda v: 255 / F.when(high(v) > low(v), high(v) - low(v)).otherwise(255.0)
    stretched = lambda v: (1 - F.col("__b") + F.col("__b") * wide(v)) * F.col(v) - F.col("__b") * low(v) * wide(v)
    # fixed value: colours are divided by 250
    colours = {v: F.when(F.col("__k") < drop, 0.0).when(F.col("__c") < contrast, stretched(v) / 250).otherwise(F.col(v) / 250) for v in "rgb"}
    df = df.withColumns({a: F.col(a) - F.col(f"__cloud_{a}") for a in "xyz"} | colours)
    return df.select(*columns, F.col("z").alias("height"))


@register
def rgb_to_hsv(df: DataFrame) -> DataFrame:
    """Add h, s (0 to 1) and v (0 to 255)."""
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    d = hi - lo
    safe = F.when(d == 0, 1.0).otherwise(d)
    h = F.when(d == 0, 0.0).when(F.col("r") == hi, F.pmod((F.col("g") - F.col("b")) / safe, F.lit(6.0))).when(F.col("g") == hi, (F.col("b") - F.col("r")) / safe + 2).otherwise((F.col("r") - F.col("g")) / safe + 4)
    return df.withColumns({"h": h / 6, "s": F.when(hi > 0, d / F.when(hi > 0, hi)).otherwise(0.0), "v": hi.cast("double")})


@register
def hsv_to_rgb(df: DataFrame) -> DataFrame:
    """r, g, b from h, s, v: each channel is v less v*s times how far the hue is from it."""
    def channel(n: int) -> Column:
        k = F.pmod(F.col("h") * 6 + n, F.lit(6.0))
        return F.col("v") - F.col("v") * F.col("s") * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return df.withColumns({"r": channel(5), "g": channel(3), "b": channel(1)})


@register
def hue_saturation(df: DataFrame, hue: float = 0.0, saturation: float = 1.0) -> DataFrame:
    d = rgb_to_hsv(df).withColumns({"h": F.pmod(F.col("h") + hue, F.lit(1.0)), "s": F.greatest(F.least(F.col("s") * saturation, F.lit(1.0)), F.lit(0.0))})
    return hsv_to_rgb(d).drop("h", "s", "v")


@register
def color_drop(df: DataFrame, factor: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in "rgb"})


@register
def crop_boundary(df: DataFrame, labels: tuple[int, ...] = (0, 1)) -> DataFrame:
    return df.where(~F.col("label").isin(*labels))


@register
def add(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


@register
def copy(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumns({new: F.col(old) for old, new in names.items()})


@register
def cast(df: DataFrame, **types: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


@register
def collect(df: DataFrame, keys: tuple[str, ...], **features: tuple[str, ...]) -> DataFrame:
    """Keep keys and build array features from groups of columns."""
    return df.select(*keys, *[F.array(*[F.col(c).cast("double") for c in cols]).alias(name) for name, cols in features.items()])


@register
def mix_pairs(df: DataFrame, p: float = 1.0, seed: int = 0) -> DataFrame:
    """Merge each even batch with the next one."""
    pair = F.floor(F.col("batch") / 2).cast("int")
    return df.withColumn("batch", F.when(F.pmod(F.xxhash64(pair, F.lit(seed)), F.lit(1000)) < int(p * 1000), pair * 2).otherwise(F.col("batch")))


@register
def instance_parser(df: DataFrame, ignored: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """Dense instance numbers within each cloud, -1 for ignored classes, and each instance's mean coordinates."""
    live = ~F.col("label").isin(*ignored) & (F.col("instance") >= 0)
    df = df.withColumn("__i", F.when(live, F.col("instance")))
    dense = F.when(F.col("__i").isNotNull(), F.dense_rank().over(Window.partitionBy("batch", F.col("__i").isNull()).orderBy("__i")) - 1).otherwise(-1)
    box = Window.partitionBy("batch", "__i")
    return df.withColumns({"instance_id": dense, **{f"center_{a}": F.when(F.col("__i").isNotNull(), F.avg(a).over(box)) for a in "xyz"}, **{f"size_{a}": F.when(F.col("__i").isNotNull(), F.max(a).over(box) - F.min(a).over(box)) for a in "xyz"}}).drop("__i")


@register
def contrastive_views(df: DataFrame, first: list[dict] = (), second: list[dict] = ()) -> DataFrame:
    """Two transformed copies side by side, joined on point_id, with the prefixes view1_ and view2_."""
    views = [Compose(list(c))(df) for c in (first, second)]
    named = [v.select("point_id", *[F.col(c).alias(f"view{i}_{c}") for c in v.columns if c != "point_id"]) for i, v in enumerate(views, 1)]
    return named[0].join(named[1], "point_id")


class Compose:
    """Transforms from a list like [{"type": "center_shift"}, {"type": "rotate", "angle": 0.3}], applied in order."""

    def __init__(self, config: list[dict]):
        self.steps = []
        for step in config:
            step = dict(step)
            name = step.pop("type")
            if name not in REGISTRY:
                raise ValueError(f"unknown transform {name!r}; there are {sorted(REGISTRY)}")
            self.steps.append((REGISTRY[name], step))

    def __call__(self, df: DataFrame) -> DataFrame:
        for f, how in self.steps:
            df = f(df, **how)
        return df
