"""A corpus pipeline of five operators; each stage's result is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubila.llm import line_dedup as lines
from nubila.llm import near_dedup, packing, substring_dedup, toxicity
from nubila.llm.workspace import Workspace


def _with_text(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The columns of docs, with the text that an operator left (empty for a null text) and its length."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[(new[c] if c in new else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return toxicity.score(rows, model).where(F.col("toxicity_score") < toxicity.THRESHOLD).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble earlier ones."""
    return _with_text(docs, lines.line_dedup(docs, with_text=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_duplicates(docs)


def drop_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated long spans."""
    return _with_text(docs, substring_dedup.substring_dedup(docs, with_text=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("substring_dedup", drop_spans), ("packing", pack)]

#: SQL cannot express these stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
