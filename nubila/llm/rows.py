"""Keys of document rows that hold for nulls and repeated ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id in keys; a key also holds the text's hash, so rows that share an id stay apart.
NULL_ID = -(1 << 63)


def row_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """did, th, text and, with keep, a struct of all columns of docs but the text."""
    cols = [row_key(F.col(id_col)).alias("did"), text_key(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    if keep:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    return docs.select(*cols)


def real_id(col: str = "did") -> Column:
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


def bigger(session_width: int, least: int) -> int:
    return max(session_width, least)
