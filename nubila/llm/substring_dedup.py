"""Removal of repeated word spans over a compacted de Bruijn graph of word windows.

A window of ``width`` words is an edge between its first and last width-1 words.  The graph is never built edge by
edge: consecutive windows of a document that share a minimizer (the least hash of their ``anchor``-word sequences) are
one path, and equal windows always lie on paths of one minimizer.  So

1. a count of minimizers leaves the paths that can repeat at all;
2. paths that are equal as a whole join into one class: a repeated path without branches stays one row;
3. only where different paths share a minimizer (a branch, or a span's ends) are they opened into edges and counted;
4. source coordinates of repeated paths and edges are joined back to their documents, and the words they cover go.

Paths and edges are compared as 64-bit hashes within the group of one 64-bit minimizer, not word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed, real_id
from .textcore import U, Words, chunks
from .workspace import KeyFilter, Workspace, test_bits

WIDTH, ANCHOR = 35, 10


def paths(words: Words, width: int, anchor: int):
    """Paths of a chunk: minimizer, first window, end window, row, and whether the minimizer lies at several places.

    Also the running sums of the word hashes.
    """
    total = words.prefix()
    n = len(words.hashes)
    reach = width - anchor + 1
    count = np.maximum(np.diff(words.at) - width + 1, 0)
    made = int(count.sum())
    if made == 0:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, z, z.astype(bool), total
    lo = np.arange(n - anchor + 1)
    least = words.joined(lo, lo + anchor, total)
    left = right = lo.astype(np.int32)
    step = 1
    while step < reach:
        by = min(step, reach - step)
        a, b = least[: len(least) - by], least[by:]
        left = np.where(b < a, left[by:], left[: len(a)])
        right = np.where(b <= a, right[by:], right[: len(a)])
        least = np.minimum(a, b)
        step += by
    row = np.repeat(np.arange(len(count)), count)
    w = words.at[:-1][row] + np.arange(made) - (np.cumsum(count) - count)[row]
    m = least[w]
    fresh = np.ones(made, bool)
    fresh[1:] = (w[1:] != w[:-1] + 1) | (m[1:] != m[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], made) - 1
    return m[first], w[first], w[last] + 1, row[first], left[w[first]] != right[w[last]], total


def _minimizers(width: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in chunks(batch.column(0)):
                m, _, _, _, twice, _ = paths(Words(data, off), width, anchor)
                keys, at = np.unique(m, return_inverse=True)
                c = np.bincount(at, weights=1 + twice, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c)], ["m", "c"])

    return run


def _paths(width: int, anchor: int, shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(2)):
                words = Words(data, off)
                m, first, end, row, twice, total = paths(words, width, anchor)
                keep = test_bits(shared.value, bits, m)
                m, first, end, row, twice = m[keep], first[keep], end[keep], row[keep], twice[keep]
                n = end - first
                whole = words.joined(first, end + width - 1, total)
                at = np.concatenate([[0], np.cumsum(n)])
                w = np.repeat(first - at[:-1], n) + np.arange(at[-1])
                edges = words.joined(w, w + width, total)
                ids = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(m.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).slice(lo, hi - lo).take(ids), batch.column(1).slice(lo, hi - lo).take(ids),
                        pa.array((first - words.at[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(edges.view(np.int64))),
                    ],
                    ["m", "s", "did", "th", "at", "n", "twice", "edges"],
                )

    return run


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _plain(shared, bits: int):
    """Finish the rows whose text the filter rules out; the others keep their text for the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            open_ = test_bits(shared.value, bits, batch.column(1).to_numpy()) if shared is not None else np.zeros(len(text), bool)
            n, sha = [], []
            for t, o in zip(text, open_):
                w = [] if o else t.as_py().encode().split()
                n.append(len(w))
                sha.append(None if o else _digest(w))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(open_)], [*batch.schema.names, "n_words", "sha", "open"])

    return run


def _cut(width: int, with_text: bool):
    """Remove the words that spans cover; text keeps what stood between words that stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(name) for name in batch.schema.names}
            n_words, removed, shas, texts = [], [], [], []
            for i in range(len(batch)):
                n, sha, gone, text = get["n_words"][i].as_py(), get["sha"][i].as_py(), 0, None
                if sha is None or with_text:
                    text = get["text"][i].as_py()
                if sha is None:
                    raw = text.encode()
                    w = raw.split()
                    n = len(w)
                    spans = get["spans"][i].values
                    if spans is not None and len(spans):
                        at = spans.field(0).to_numpy().astype(np.int64)
                        size = spans.field(1).to_numpy()
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, np.minimum(at + size, n), -1)
                        kept = np.cumsum(edge[:-1]) == 0
                        gone = int(n - kept.sum())
                        if with_text and gone:
                            words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                            turn = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
                            text = b" ".join(raw[words.starts[a] : words.ends[b - 1]] for a, b in zip(turn[::2], turn[1::2])).decode()
                        w = [x for x, k in zip(w, kept) if k]
                    sha = _digest(w)
                n_words.append(n)
                removed.append(gone)
                shas.append(sha)
                if with_text:
                    texts.append(text)
            arrays = [get["did"], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["did", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays += [pa.array(texts, pa.string()), get["rest"]]
                names += ["text", "rest"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def repeated_spans(ws: Workspace, src: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(did, th, spans array<struct<at,size>>): the words that repeated windows cover, by document."""
    often = (
        src.select("text").mapInArrow(_minimizers(width, anchor), "m long, c long")
        .groupBy("m").agg(F.sum("c").alias("c")).where("c > 1").select("m")
    )
    often = ws.save(often, "minimizers")
    count = often.count()
    if not count:
        return ws.spark.createDataFrame([], "did long, th long, spans array<struct<at:int,size:int>>")
    bitmap = KeyFilter(often, "m", count)
    made = src.select("did", "th", "text").mapInArrow(_paths(width, anchor, bitmap.shared, bitmap.bits), "m long, s long, did long, th long, at int, n int, twice boolean, edges array<long>")
    made = ws.save(made, "paths")
    ws.drop(often)
    classes = ws.save(
        made.groupBy("m", "s", "n").agg(F.count("*").alias("c"), F.max("twice").alias("twice"), F.min(F.struct("did", "th", "at")).alias("src"), F.first("edges").alias("edges")),
        "classes",
    )
    branch = classes.groupBy("m").agg(F.count("*").alias("g"), F.sum("c").alias("t"), F.max("twice").alias("w")).where("g > 1 or w").select("m")
    # the edges of paths that share a minimizer with another path
    opened = ws.save(classes.join(branch, "m", "left_semi").select("m", "c", "src", F.posexplode("edges").alias("i", "e")), "edges")
    repeated = opened.groupBy("m", "e").agg(F.sum("c").alias("k")).where("k > 1").select("m", "e")
    single = opened.where("c = 1").join(repeated, ["m", "e"], "left_semi").select("src.did", "src.th", (F.col("src.at") + F.col("i")).alias("at"), F.lit(1).alias("n"))
    whole = made.select("m", "s", "did", "th", "at", "n").join(classes.where("c > 1").select("m", "s", "n"), ["m", "s", "n"], "left_semi").select("did", "th", "at", "n")
    found = whole.unionByName(single)
    # rows that share id and text have the same spans: once
    return ws.save(found.groupBy("did", "th").agg(F.collect_set(F.struct("at", (F.col("n") + F.lit(width - 1)).alias("size"))).alias("spans")), "spans")


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """Remove each word that a window of ``width`` words covers whose word sequence also starts elsewhere.

    Words are runs outside \\x20 and \\x09-\\x0D, compared unchanged; windows are judged on the input.  Returns
    (doc_id, n_words, n_removed, kept_sha256), one row per row; with ``with_text`` also the text that is left
    (untouched if nothing goes) and ``rest``, a struct of the other columns.

    Null or empty text: no words, nothing removed, the digest of nothing.  Null ids: doc_id is null, the row is treated
    like any other.  Repeated rows are documents of their own: their windows repeat each other.  Texts shorter than
    a window are never cut.
    """
    ws = Workspace(docs.sparkSession, "substring")
    src = keyed(docs, id_col, text_col, keep=with_text)
    spans = repeated_spans(ws, src, width, anchor)
    n = spans.count()
    ws.release()
    bitmap = KeyFilter(spans, "th", n) if n else None
    kind = src.schema
    parts = "did long, th long, text string" + (f", rest {kind['rest'].dataType.simpleString()}" if with_text else "")
    plain = src.mapInArrow(_plain(bitmap and bitmap.shared, bitmap.bits if bitmap else 0), f"{parts}, n_words long, sha string, open boolean")
    if not with_text:
        plain = plain.withColumn("text", F.when(F.col("open"), F.col("text")))
    joined = plain.join(spans, ["did", "th"], "left") if n else plain.withColumn("spans", F.lit(None).cast("array<struct<at:int,size:int>>"))
    out = "did long, n_words long, n_removed long, kept_sha256 string" + (f", text string, rest {kind['rest'].dataType.simpleString()}" if with_text else "")
    done = joined.mapInArrow(_cut(width, with_text), out)
    return done.select(real_id().alias("doc_id"), *[c for c in done.columns if c != "did"])
