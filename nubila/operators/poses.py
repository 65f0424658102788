"""Chains of frames and 4x4 transforms as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import ranks

#: Frames of a chain that are dealt together, rows that a task makes at a time.
STRETCH, AT_ONCE = 1024, 1 << 15


def matrix(translation: Column, rotation: Column) -> Column:
    """The 4x4 transform, row by row as an array of 16, of a translation and a unit quaternion (w, x, y, z)."""
    w, x, y, z = (F.get(rotation, F.lit(i)) for i in range(4))
    turn = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    cells = [c for i in range(3) for c in (*turn[i], F.get(translation, F.lit(i)))]
    return F.array(*cells, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def inverted(m: Column) -> Column:
    """The inverse of a rigid transform: the rotation transposed, the translation turned back."""
    at = lambda i, j: F.get(m, F.lit(4 * i + j))
    cells = []
    for i in range(3):
        cells += [at(0, i), at(1, i), at(2, i), -(at(0, i) * at(0, 3) + at(1, i) * at(1, 3) + at(2, i) * at(2, 3))]
    return F.array(*cells, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def product(a: Column, b: Column) -> Column:
    """a times b; for columns, not for long expressions, since each cell is used four times."""
    return F.array(*[sum((F.get(a, F.lit(4 * i + k)) * F.get(b, F.lit(4 * k + j)) for k in range(1, 4)), F.get(a, F.lit(4 * i)) * F.get(b, F.lit(j))) for i in range(4) for j in range(4)])


def moved(points: DataFrame, m: str = "transform") -> DataFrame:
    """points with x, y, z transformed by the row's matrix; rows without one stay."""
    at = lambda i, j: F.get(F.col(m), F.lit(4 * i + j))
    new = {a: F.coalesce(at(i, 0) * F.col("x") + at(i, 1) * F.col("y") + at(i, 2) * F.col("z") + at(i, 3), F.col(a)) for i, a in enumerate("xyz")}
    return points.select(*[new[c].alias(c) if c in new else F.col(c) for c in points.columns])


def paths(links: DataFrame, most: int) -> DataFrame:
    """(token, path): the tokens that 1 to ``most`` steps along ``prev`` lead to, from links (token, prev), one row per token that has any.

    Pointer doubling: ways of n steps, joined with what their ends lead to, give 2n, so there are log2(most) joins however long chains are.
    """
    found = links.where(F.col("prev").isNotNull()).select("token", F.array("prev").alias("path"))
    n = 1
    while n < most:
        found = checkpointed(found)
        onward = found.select(F.col("token").alias("__mid"), F.slice("path", 1, min(n, most - n)).alias("__more"))
        # chains that have ended stay where they are
        going = found.where(F.size("path") == n).withColumn("__mid", F.element_at("path", -1)).join(onward, "__mid", "left")
        longer = going.select("token", F.when(F.col("__more").isNull(), F.col("path")).otherwise(F.concat("path", "__more")).alias("path"))
        found = longer.unionByName(found.where(F.size("path") < n))
        n *= 2
    return found


def ancestors(links: DataFrame, most: int) -> DataFrame:
    """(token, step, target): what 1 to ``most`` steps along ``prev`` lead to, from links (token, prev); null prev ends a chain."""
    return paths(links, most).select("token", F.posexplode("path").alias("step", "target")).withColumn("step", F.col("step") + 1)


def sweep_chain(frames: DataFrame, most: int) -> DataFrame:
    """(token, step, sweep, lag, transform): the ``most`` - 1 frames before each frame along ``prev``.

    Poses are rigid.  frames: token, prev (null or unknown at a chain's start), ts, car_pose (global from car) and sensor_pose (car from sensor), 4x4
    arrays.  transform takes the sweep's sensor coordinates to those of the frame's sensor: through the sweep's car, the world and the
    frame's car.  Where a chain ends, its last sweep is repeated; a frame without any before it is its own sweep, with lag 0 and
    no transform.
    """
    steps = most - 1
    # materialised step by step: the optimizer would put the cells' formulas into each other, and every use would derive the frames anew
    world = checkpointed(frames.select("token", "prev", "ts", "car_pose", "sensor_pose"))
    world = checkpointed(world.select("token", "prev", "ts", product(F.col("car_pose"), F.col("sensor_pose")).alias("__own")))
    known = world.select("token", "prev").join(world.select(F.col("token").alias("prev")), "prev", "left_semi")
    ways = checkpointed(paths(known, steps))
    # a frame goes to each of its sweeps once; its last one is repeated when the transform is there
    each = world.join(ways, "token").select("token", "ts", "__own", F.size("path").alias("__n"), F.posexplode("path").alias("__pos", "target"))
    out = world.select(F.col("token").alias("target"), F.col("ts").alias("__then"), F.col("__own").alias("__out"))
    met = each.join(out, "target").select("token", F.col("target").alias("sweep"), (F.col("ts") - F.col("__then")).alias("lag"), "__pos", "__n", product(inverted(F.col("__own")), F.col("__out")).alias("transform"))
    upto = F.when(F.col("__pos") + 1 == F.col("__n"), F.lit(steps)).otherwise(F.col("__pos") + 1)
    met = met.select("token", F.explode(F.sequence(F.col("__pos") + 1, upto)).alias("step"), "sweep", "lag", "transform")
    alone = world.select("token", "ts").join(ways.select("token"), "token", "left_anti")
    alone = alone.select("token", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.col("token").alias("sweep"), (F.col("ts") - F.col("ts")).alias("lag"), F.lit(None).cast(met.schema["transform"].dataType).alias("transform"))
    return met.unionByName(alone)


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """Matrices as 16 rows of numbers, and of which of them are null (None: none is)."""
    n = len(column)
    if not column.null_count and not column.flatten().null_count:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, 16).T, None
    rows = [m if m is not None else [None] * 16 for m in column.to_pylist()]
    return np.array([[0.0 if v is None else v for v in m] for m in rows]).T, np.array([[v is None for v in m] for m in rows]).T


def _of_cells(make: Callable, *parts: tuple[np.ndarray, np.ndarray | None]) -> tuple[np.ndarray, np.ndarray | None]:
    """What ``make`` has of matrices; cells are null that come of a null one."""
    if all(null is None for _, null in parts):
        return make(*(m for m, _ in parts), np.multiply, np.add, np.negative), None
    nulls = [np.zeros(m.shape, bool) if null is None else null for m, null in parts]
    return make(*(m for m, _ in parts), np.multiply, np.add, np.negative), make(*nulls, np.logical_or, np.logical_or, np.array)


def _product(a: np.ndarray, b: np.ndarray, times, plus, minus) -> np.ndarray:
    """product() of matrices in rows."""
    out = np.empty(a.shape, a.dtype)
    for i in range(4):
        for j in range(4):
            cell = times(a[4 * i], b[j])
            for k in range(1, 4):
                cell = plus(cell, times(a[4 * i + k], b[4 * k + j]))
            out[4 * i + j] = cell
    return out


def _inverted(m: np.ndarray, times, plus, minus) -> np.ndarray:
    """inverted() of matrices in rows."""
    out = np.array(m)
    for i in range(3):
        for j in range(3):
            out[4 * i + j] = m[4 * j + i]
        out[4 * i + 3] = minus(plus(plus(times(m[i], m[3]), times(m[4 + i], m[7])), times(m[8 + i], m[11])))
    return out


def _rounded(m: np.ndarray, digits: int) -> np.ndarray:
    """To so many digits, halves away from zero, by the scaled double; zeros without a sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = m * 10.0**digits
        near = np.rint(scaled)
        out = np.where(np.abs(scaled - near) == 0.5, scaled + np.copysign(0.5, scaled), near) / 10.0**digits
        return np.where(np.isfinite(out), out, m) + 0.0


def _swept(steps: int, digits: int | None):
    """The sweeps of the frames that are a row's own; a frame's position tells how many rows right before it are of its chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        size = max(1, AT_ONCE // steps)
        for rb in batches:
            for lo in range(0, rb.num_rows, size):
                part = rb.slice(lo, size)
                n = part.num_rows
                car, sensor = _cells(part.column("car_pose")), _cells(part.column("sensor_pose"))
                into = _of_cells(_product, _of_cells(_inverted, sensor), _of_cells(_inverted, car))
                out = _of_cells(_product, car, sensor)
                token, ts, (cells, null) = part.column("token"), part.column("ts"), out
                if held is not None:
                    token, ts = pa.concat_arrays([held[0], token]), pa.concat_arrays([held[1], ts])
                    cells = np.concatenate([held[2], cells], axis=1)
                    if null is not None or held[3] is not None:
                        null = np.concatenate([np.zeros((16, k), bool) if x is None else x for x, k in ((held[3], len(held[0])), (null, n))], axis=1)
                keep = slice(max(0, len(token) - steps), None)
                before = np.minimum(part.column("position").to_numpy(), steps)
                own = np.flatnonzero(part.column("own").to_numpy(zero_copy_only=False))
                row, step = np.repeat(own, steps), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(own))
                back = np.minimum(step, before[row])
                now = len(token) - n + row
                to = now - back
                got, none = _of_cells(_product, (into[0][:, row], into[1] if into[1] is None else into[1][:, row]), (cells[:, to], null if null is None else null[:, to]))
                if digits is not None:
                    got = _rounded(got, digits)
                values = pa.array(np.ascontiguousarray(got.T).ravel(), mask=None if none is None else np.ascontiguousarray(none.T).ravel())
                transform = pa.ListArray.from_arrays(pa.array(16 * np.arange(len(row) + 1, dtype=np.int32)), values, mask=pa.array(back == 0))
                if len(row):
                    yield pa.RecordBatch.from_arrays([token.take(pa.array(now)), pa.array(step), token.take(pa.array(to)), ts.take(pa.array(now)), ts.take(pa.array(to)), transform], ["token", "step", "sweep", "ts", "then", "transform"])
                held = [token[keep], ts[keep], cells[:, keep], None if null is None else null[:, keep]]

    return run


def sweep_rows(rows: DataFrame, most: int, by: tuple[str, ...], order: tuple[str, ...], posed: Callable[[DataFrame], DataFrame], digits: int | None = None) -> DataFrame:
    """sweep_chain() where it is known which frames make a chain: those of one ``by``, in ``order``, each following the one before it.

    Stretches of a chain are dealt together, and the ends of the ones before them with them, so a pose isn't sent to all frames
    that refer to it.  Pass few columns: they are shuffled twice and written once; ``posed`` adds token, ts, car_pose and sensor_pose to
    the rows, each from its own row.  With ``digits`` transforms are rounded.
    """
    steps = most - 1
    length = max(STRETCH, 8 * steps)
    placed = ranks.running(rows, list(by), list(order))
    at, place = F.floor(F.col("position") / length), F.col("position") % length
    dealt = placed.withColumn("own", F.explode(F.when(place >= length - steps, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    dealt = dealt.withColumn("stretch", F.when(F.col("own"), at).otherwise(at + 1))
    # a given number of partitions: AQE would merge them by their few bytes, however much comes of them
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *by, "stretch").sortWithinPartitions(*by, "stretch", "position")
    frames = posed(dealt).select("token", "ts", "position", "own", "car_pose", "sensor_pose")
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    out = frames.mapInArrow(_swept(steps, digits), f"token {kinds['token']}, step int, sweep {kinds['token']}, ts {kinds['ts']}, then {kinds['ts']}, transform array<double>")
    return out.select("token", "step", "sweep", (F.col("ts") - F.col("then")).alias("lag"), "transform")
