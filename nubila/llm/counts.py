"""Counts over a fixed number of slots: dense in each task, compressed blocks in the shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import from_planes, planes

BLOCK = 1 << 12


def _blocks(size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        some = False
        for batch in batches:
            some = some or len(batch) > 0
            add(batch, total)
        if some:
            parts = total.reshape(-1, BLOCK)
            full = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([_pack(parts[i]) for i in full], pa.binary())], ["block", "counts"])

    return run


def _pack(x: np.ndarray) -> bytes:
    # bytes of one weight side by side compress better
    return zlib.compress(planes(x.astype(np.uint64)), 1)


def _unpack(x: bytes) -> np.ndarray:
    return from_planes(zlib.decompress(x), BLOCK).view(np.int64)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks that come sorted by block; one block is held at a time."""
    at, total = None, None
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_pack(total)], pa.binary())], ["block", "counts"])
                at, total = block, np.zeros(BLOCK, np.int64)
            total += _unpack(counts)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_pack(total)], pa.binary())], ["block", "counts"])


def slot_counts(texts: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """Total counts by slot over all rows; add(batch, total) counts one batch.

    A task sends its nonzero blocks once, so the shuffle grows with the number of tasks; the result has a fixed size.
    """
    parts = texts.mapInArrow(_blocks(size, add), "block int, counts binary")
    width = max(2, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = parts.repartition(width, F.col("block")).sortWithinPartitions("block").mapInArrow(_sum, "block int, counts binary").toArrow()
    total = np.zeros((size // BLOCK, BLOCK), np.int64)
    for block, counts in zip(rows.column("block").to_pylist(), rows.column("counts").to_pylist()):
        total[block] = _unpack(counts)
    return total.ravel()
