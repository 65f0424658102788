"""Positions and running sums within groups, without a task per group.

Rows are dealt by ranges of (group, order), so a group of any size lies on neighbouring partitions.  Each partition numbers its
rows and adds up on its own; one row per partition tells how much of its last group precedes the next partition, and that is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows of a table of groups up to which it is sent to every task.
SMALL = 100_000


def _fresh(batch: pa.RecordBatch, by: list[str], last: list | None) -> np.ndarray:
    """Which rows start a group; the rows are in order of the groups, ``last`` is the group of the row before."""
    out = np.zeros(batch.num_rows, bool)
    for i, name in enumerate(by):
        column = batch.column(name)
        head, tail = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(head, tail), False), pc.and_(pc.is_null(head), pc.is_null(tail)))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
        out[0] |= last is None or column[0].as_py() != last[i]
    return out


def _local(by: list[str], sums: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, groups = None, 0
        carry = np.zeros(1 + len(sums), np.int64)
        held: pa.RecordBatch | None = None

        def made(batch: pa.RecordBatch, end: bool) -> pa.RecordBatch:
            nonlocal last, groups, carry
            n = batch.num_rows
            fresh = _fresh(batch, by, last)
            number = np.cumsum(fresh)
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            columns = []
            each = [np.ones(n, np.int64), *[batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in sums]]
            for k, v in enumerate(each):
                total = np.cumsum(v)
                before = total - v
                columns.append(before - np.where(number > 0, before[start], -carry[k]))
                carry[k] = columns[-1][-1] + v[-1]
            first = groups + number <= 1
            last = [batch.column(b)[n - 1].as_py() for b in by]
            groups += int(number[-1])
            # on a partition's last row: how much of its last group there is so far
            tail = pa.array([None] * (n - 1) + [carry.tolist() if end else None], pa.list_(pa.int64()))
            arrays = [*batch.columns, *[pa.array(c) for c in columns], pa.array(np.full(n, part, np.int32)), pa.array(first), tail]
            return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, name, *[f"{s}_before" for s in sums], "__part", "__first", "__tail"])

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield made(held, False)
                held = batch
        if held is not None:
            yield made(held, True)

    return run


def running(df: DataFrame, by: list[str], order: list[str], sums: tuple[str, ...] = (), name: str = "position", parts: int | None = None) -> DataFrame:
    """df with ``name``, a row's place from 0 on in its group's order, and for each column of ``sums`` the sum over the rows before it.

    Sums are of whole numbers without nulls.  ``order`` must tell the rows of a group apart, else equal rows are placed as they
    come; descending order is asked for by a leading minus.  Nulls in ``by`` are a group.  Pass few columns: all of them are shuffled
    once and written to the shared folder.
    """
    spark = df.sparkSession
    keys = [F.col(b) for b in by] + [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    kind = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{name}` bigint", *[f"`{s}_before` bigint" for s in sums], "__part int", "__first boolean", "__tail array<bigint>"]
    local = checkpointed(ranged.mapInArrow(_local(by, list(sums), name), ", ".join(kind)))
    # a row per partition that has any
    ends = sorted(local.where("__tail is not null").select("__part", "__first", "__tail", F.struct(*by).alias("g") if by else F.lit(0).alias("g")).collect(), key=lambda r: r["__part"])
    heads = {r["__part"]: r["g"] for r in local.where(F.col("__first") & (F.col(name) == 0)).select("__part", F.struct(*by).alias("g") if by else F.lit(0).alias("g")).collect()}
    rows, group, upto = [], None, None
    for r in ends:
        part, tail = r["__part"], list(r["__tail"])
        before = upto if upto is not None and group == heads[part] else [0] * len(tail)
        rows.append((part, *before))
        group, upto = r["g"], [a + b for a, b in zip(tail, before)] if r["__first"] else tail
    added = [name, *[f"{s}_before" for s in sums]]
    table = spark.createDataFrame(rows, "__part int, " + ", ".join(f"__o{i} bigint" for i in range(len(added))))
    out = local.join(F.broadcast(table), "__part")
    more = {c: F.col(c) + F.when(F.col("__first"), F.col(f"__o{i}")).otherwise(0) for i, c in enumerate(added)}
    return out.select(*df.columns, *[more[c].alias(c) for c in added])


def with_groups(df: DataFrame, groups: DataFrame, keys: list[str], most: int = SMALL) -> DataFrame:
    """df joined with a table that has one row per group: sent to every task if it has at most ``most`` rows, else shuffled.

    Groups are counted first, so that a cloud or class with most of the rows isn't dealt to one task.  Null keys meet.
    """
    found = checkpointed(groups)
    side = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    if found.count() <= most:
        side = F.broadcast(side)
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return df.join(side, on).drop(*[f"__{k}" for k in keys])
