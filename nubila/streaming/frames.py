"""Frame-at-a-time processing: batch operators applied to each micro-batch of a stream of points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def each_frame(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to the frames (batch column) of each micro-batch and write the result, once per epoch.

    An epoch that is run again after a failure overwrites its own folder, so results are neither lost nor doubled.
    """

    def write(df: DataFrame, epoch: int) -> None:
        operator(df).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch_id={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Points per frame window with a watermark for late ones."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), "batch").agg(F.count("*").alias("cnt"))
