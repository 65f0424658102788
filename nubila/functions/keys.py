"""Space-filling-curve keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (shift, mask) pairs that spread 16 bits to every third place.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def quantise(c: Column, size: float) -> Column:
    """Cell of a coordinate, rounding down."""
    return F.floor(c / F.lit(float(size))).cast("long")


def spread(c: Column) -> Column:
    c = c.cast("long").bitwiseAND(F.lit(0xFFFF))
    for by, mask in SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
    return c


def gather(c: Column) -> Column:
    """Every third bit of c, side by side: the inverse of spread()."""
    c = c.bitwiseAND(F.lit(SPREAD[-1][1]))
    for (by, _), mask in zip(reversed(SPREAD), [m for _, m in reversed(SPREAD[:-1])] + [0xFFFF]):
        c = c.bitwiseOR(F.shiftright(c, by)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column, z: Column, batch: Column | None = None) -> Column:
    """x takes bits 3i+2, y 3i+1, z 3i; batch the bits from 48 on."""
    key = F.shiftleft(spread(x), 2).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(spread(z))
    return key if batch is None else key.bitwiseOR(F.shiftleft(batch.cast("long"), 48))


def morton_decode(key: Column) -> dict[str, Column]:
    return {
        "gx": gather(F.shiftright(key, 2)), "gy": gather(F.shiftright(key, 1)), "gz": gather(key),
        "batch": F.shiftright(key, 48).cast("int"),
    }


def hilbert(df: DataFrame, x: str, y: str, z: str, depth: int, out: str = "key") -> DataFrame:
    """Add the 3-D Hilbert key of non-negative cells below 2**depth, by Skilling's transposition bit by bit.

    Each bit's step is a projection of its own, so no expression grows with the depth squared.
    """
    names = ["__h0", "__h1", "__h2"]
    df = df.withColumns({n: F.col(c).cast("long") for n, c in zip(names, (x, y, z))})
    for b in range(depth - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for n in names:
            on = F.col(n).bitwiseAND(F.lit(bit)) != 0
            first = F.col(names[0])
            swap = first.bitwiseXOR(F.col(n)).bitwiseAND(F.lit(low))
            if n == names[0]:
                df = df.withColumn(n, F.when(on, first.bitwiseXOR(F.lit(low))).otherwise(first))
            else:
                df = df.withColumns({names[0]: F.when(on, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap)), n: F.when(on, F.col(n)).otherwise(F.col(n).bitwiseXOR(swap))})
    df = df.withColumn(names[1], F.col(names[1]).bitwiseXOR(F.col(names[0])))
    df = df.withColumn(names[2], F.col(names[2]).bitwiseXOR(F.col(names[1])))
    df = df.withColumn("__flip", F.lit(0).cast("long"))
    for b in range(depth - 1, 0, -1):
        df = df.withColumn("__flip", F.when(F.col(names[2]).bitwiseAND(F.lit(1 << b)) != 0, F.col("__flip").bitwiseXOR(F.lit((1 << b) - 1))).otherwise(F.col("__flip")))
    key = F.shiftleft(spread(F.col(names[0]).bitwiseXOR(F.col("__flip"))), 2)
    key = key.bitwiseOR(F.shiftleft(spread(F.col(names[1]).bitwiseXOR(F.col("__flip"))), 1)).bitwiseOR(spread(F.col(names[2]).bitwiseXOR(F.col("__flip"))))
    return df.withColumn(out, key).drop(*names, "__flip")


def hilbert_decode(df: DataFrame, key: str, depth: int, out: tuple[str, str, str] = ("gx", "gy", "gz")) -> DataFrame:
    """Add the cells of 3-D Hilbert keys: hilbert() undone, its steps in reverse order."""
    names = ["__h0", "__h1", "__h2"]
    df = df.withColumns({n: gather(F.shiftright(F.col(key).cast("long"), 2 - i)) for i, n in enumerate(names)})
    # a bit was flipped once for each bit above it that the third axis had, which its own flipped bits now tell
    flip = F.shiftright(names[2], 1)
    return _undone(df.withColumn("__flip", flip).withColumns({n: F.col(n).bitwiseXOR(F.col("__flip")) for n in names}).drop("__flip"), names, depth, out)


def _undone(df: DataFrame, names: list[str], depth: int, out: tuple[str, str, str]) -> DataFrame:
    df = df.withColumn(names[2], F.col(names[2]).bitwiseXOR(F.col(names[1])))
    df = df.withColumn(names[1], F.col(names[1]).bitwiseXOR(F.col(names[0])))
    for b in range(1, depth):
        bit, low = 1 << b, (1 << b) - 1
        for n in reversed(names):
            on = F.col(n).bitwiseAND(F.lit(bit)) != 0
            first = F.col(names[0])
            swap = first.bitwiseXOR(F.col(n)).bitwiseAND(F.lit(low))
            if n == names[0]:
                df = df.withColumn(n, F.when(on, first.bitwiseXOR(F.lit(low))).otherwise(first))
            else:
                df = df.withColumns({names[0]: F.when(on, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap)), n: F.when(on, F.col(n)).otherwise(F.col(n).bitwiseXOR(swap))})
    return df.withColumns({o: F.col(n) for o, n in zip(out, names)}).drop(*names)


def serialized(df: DataFrame, order: str, depth: int, out: str = "code") -> DataFrame:
    """Key of (batch, gx, gy, gz) in the order z, z-trans, hilbert or hilbert-trans; -trans swaps x and y."""
    x, y = ("gy", "gx") if order.endswith("-trans") else ("gx", "gy")
    if order.startswith("z"):
        df = df.withColumn(out, morton(F.col(x), F.col(y), F.col("gz")))
    elif order.startswith("hilbert"):
        df = hilbert(df, x, y, "gz", depth, out)
    else:
        raise ValueError(f"unknown order {order!r}")
    return df.withColumn(out, F.shiftleft(F.col("batch").cast("long"), 3 * depth).bitwiseOR(F.col(out)))
