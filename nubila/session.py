"""Session settings for point-cloud plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "nubila", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and a pinned time zone; conf overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def checkpointed(df):
    """Cut the lineage between driver-side rounds: a reliable checkpoint in the shared folder.

    The folder is spark.checkpoint.dir, or a temporary one where none is set and Spark runs in one process.
    """
    import re
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="nubila-rounds-"))
    return df.checkpoint(eager=True)
