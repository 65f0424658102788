"""Exact deduplication over an extendible-hash index that is written to shared files.

Everything on this path is DataFrame or SQL functions.  The index is a directory (hash prefix -> bucket) and bucket
files.  The directory starts with one bucket and doubles while a bucket holds more distinct keys than ``capacity``;
only overfull buckets split, the others stay shared by several directory entries.  Owners are the tasks of an
aggregation on (bucket, key, text): they chain the entries of one key, compare texts byte by byte and write what they
own.  Spark deals their work by a hash of all three rather than by ranges of buckets, so that copies meet in the map
tasks and no bucket has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import real_id, row_key
from .workspace import Workspace

#: Distinct keys of a bucket before it splits, and bits of a key that the directory may use (65,536 entries at most).
CAPACITY, MAX_DEPTH = 50_000, 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def directory(keys: DataFrame, capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """(entry, bucket, local depth) for every prefix of the final global depth.

    The driver sees counts per prefix only, 2**max_depth at most.
    """
    counts = {r[0]: r[1] for r in keys.distinct().groupBy(_prefix(F.col("hkey"), max_depth).alias("p")).agg(F.count("*").alias("n")).collect()}
    size = {(0, 0): sum(counts.values())}  # (local depth, prefix) -> keys
    work, done, depth = [(0, 0)], [], 0
    totals = [counts]  # by depth, from max_depth down
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for p, n in totals[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        totals.append(up)
    totals.reverse()
    while work:
        local, prefix = work.pop()
        if size[local, prefix] <= capacity or local == max_depth:
            done.append((local, prefix))
            continue
        depth = max(depth, local + 1)  # the directory doubles when the bucket's depth was the global one
        for child in (2 * prefix, 2 * prefix + 1):
            size[local + 1, child] = totals[local + 1].get(child, 0)
            work.append((local + 1, child))
    done.sort(key=lambda b: b[1] << (max_depth - b[0]))
    return [(e, bucket, local) for bucket, (local, prefix) in enumerate(done) for e in range(prefix << (depth - local), (prefix + 1) << (depth - local))]


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket), one row per row of docs.

    Texts are equal when identical after each run of \\x20 and \\x09-\\x0D becomes one space.  Of equal texts the row
    with the smallest doc_id stays.

    Null text counts as empty.  Null ids sort before all others, so such a row stays, with keep_id null.  Rows
    that repeat an id and a text are all marked kept if that id is the smallest.  Other columns are ignored.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    norm = normalised(F.col(text_col))
    rows = docs.select(row_key(F.col(id_col)).alias("did"), norm.alias("norm")).withColumn("hkey", F.xxhash64("norm"))
    entries = directory(rows.select("hkey"), capacity, max_depth)
    depth = max(len(entries) - 1, 0).bit_length()
    table = spark.createDataFrame(entries or [(0, 0, 0)], "entry int, bucket int, local_depth int").coalesce(1)
    table = ws.save(table, "directory")
    # at most 2**max_depth entries of a few bytes
    placed = rows.join(F.broadcast(table.select("entry", "bucket")), _prefix(F.col("hkey"), depth) == F.col("entry"))
    # the owners' work: entries of one key chain up, the aggregation compares whole texts; copies meet in each map task first
    chained = placed.groupBy("bucket", "hkey", "norm").agg(F.min("did").alias("keep"), F.count("*").alias("group_size"))
    index = ws.save(chained.select("bucket", "hkey", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "group_size"), "buckets")
    probe = rows.select("did", "hkey", F.unhex(F.sha2("norm", 256)).alias("sha"))
    found = probe.join(index, ["hkey", "sha"])
    return found.select(
        real_id().alias("doc_id"), real_id("keep").alias("keep_id"), F.col("group_size"), (F.col("did") == F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("bucket")
    )
