"""Intermediate tables in the folder that all executors share, and bounded semi-join filters."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that is sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; long documents make small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where none is set and Spark runs in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nubila-"))
            named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Workspace:
    """Tables of one run of one operator, as Parquet below the shared folder.

    A written table cuts the lineage: an executor that is lost later costs only the tasks that read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._nubila_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads, and let Spark drop shuffle files of ended jobs."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._nubila_path)
            path.getFileSystem(conf).delete(path, True)
        self.release()

    def release(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


class KeyFilter:
    """A bitmap over hashed keys: no false negatives, some false positives.

    It reduces what a scan sends into an exact join; the join decides.  Its size follows the number of keys
    up to MAX_BITS (32 MB), a fixed bound for the broadcast; beyond that it lets more rows through to the join.
    """

    MIN_BITS, MAX_BITS = 1 << 15, 1 << 28

    def __init__(self, keys: DataFrame, key: str, count: int):
        spark = keys.sparkSession
        bits = self.MIN_BITS
        while bits < min(self.MAX_BITS, 16 * count):
            bits *= 2
        slot = key_slot(F.col(key), bits)
        rows = (
            keys.select(slot.alias("slot"))
            .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
            .toArrow()
        )
        table = np.zeros(bits // 8 + 8192, dtype=np.uint8)
        for bucket, bitmap in zip(rows.column("bucket").to_pylist(), rows.column("bitmap").to_pylist()):
            at = (bucket - 1) * 4096
            part = np.frombuffer(bitmap, dtype=np.uint8)
            table[at : at + len(part)] = part
        self.bits = bits
        self.shared = spark.sparkContext.broadcast(table)

    def test(self, keys: np.ndarray) -> np.ndarray:
        """Which of the 64-bit keys may be in the set; for use on executors."""
        return test_bits(self.shared.value, self.bits, keys)


def test_bits(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    # bucket 1 holds the slots 1..32768 at bit positions 0..32767 in little-endian bit order per byte
    at = _fold(keys.astype(np.uint64)) & np.uint64(bits - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _fold(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(32))


def key_slot(key: Column, bits: int) -> Column:
    """Slot 1..bits of a well-mixed 64-bit key; the same as in test_bits()."""
    return key.bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseAND(F.lit(bits - 1)) + F.lit(1)
