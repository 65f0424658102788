"""The queries op1 .. op13 over the shared tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir)).drop("bucket")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import counted_difference

    return counted_difference(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(_docs(spark, sf_dir))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_docs(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_docs(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints_with_next

    return fingerprints_with_next(_docs(spark, sf_dir))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import revisit_table

    return revisit_table(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import centroid_clusters

    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language_id

    return language_id(_docs(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(_docs(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS origin FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND origin <> page_id THEN origin END AS refers_to
FROM q
"""


def oracle_sql() -> dict[str, str]:
    from .clustering import brute_force_sql

    return {"op1_exact_dedup": OP1_SQL, "op8_warc_revisits": OP8_SQL, "op11_centroid_clusters": brute_force_sql()}
