"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import real_id, row_key
from .textcore import U, Words, chunks, mix, shingles
from .workspace import Workspace

BINS, BITS, SIZE = 512, 4, 5
_NONE = U(0xFFFFFFFFFFFFFFFF)


def one_permutation(row: np.ndarray, values: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """(rows, bins): each shingle is hashed once; its high bits name the bin, a bin keeps its least hash."""
    h = mix(values ^ U(0x1F83D9ABFB41BD6B))
    at = (h >> U(64 - (bins - 1).bit_length())).astype(np.int64)
    out = np.full(rows * bins, _NONE)
    np.minimum.at(out, row * bins + at, h)
    return out.reshape(rows, bins)


def densify(sketch: np.ndarray) -> np.ndarray:
    """Fill each empty bin from a filled one, searched for with hashes of (bin, attempt) that all documents share.

    Every filled bin is equally likely to be taken, independently for each empty bin.  Rows without shingles stay empty.
    """
    rows, bins = sketch.shape
    filled = sketch != _NONE
    count = filled.sum(axis=1)
    out = sketch.copy()
    one = np.flatnonzero(count == 1)
    if len(one):
        out[one] = sketch[one].min(axis=1)[:, None]
    r, b = np.nonzero(~filled & (count > 1)[:, None])
    attempt = 1
    while len(r):
        to = (mix(b.astype(U) * U(0x9E3779B97F4A7C15) + U(attempt * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)) >> U(20)).astype(np.int64) % bins
        hit = filled[r, to]
        out[r[hit], b[hit]] = sketch[r[hit], to[hit]]
        r, b = r[~hit], b[~hit]
        attempt += 1
    return out


def low_bits(texts: list[str], bins: int = BINS, size: int = SIZE) -> np.ndarray:
    """(texts, bins) of BITS-bit values; a text without words is all zero."""
    parts = []
    for lo, hi, data, off in chunks(pa.array(texts, pa.large_string())):
        row, values = shingles(Words(data, off, lower=True), size)
        sketch = densify(one_permutation(row, values, hi - lo, bins))
        # the top bits of a hash name its bin, so the low ones are free
        parts.append(np.where(sketch == _NONE, 0, sketch & U((1 << BITS) - 1)).astype(np.uint8))
    return np.concatenate(parts) if parts else np.zeros((0, bins), np.uint8)


def packed(bits: np.ndarray) -> list[str]:
    """Hex strings, two 4-bit values to a byte."""
    both = (bits[:, ::2] << 4 | bits[:, 1::2]).astype(np.uint8)
    return [x.tobytes().hex() for x in both]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal values, less what chance makes equal, between 0 and 1."""
    chance = 0.5**BITS
    return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0, 1)


def likeness_of(a: str, b: str) -> float:
    """likeness() of two fingerprint strings."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    x, y = (np.stack([v >> 4, v & 15]).ravel() for v in (x, y))
    return float(likeness(x, y))


def _route(bounds: np.ndarray, least: int | None):
    """Send each document to its range, and the first of a range also to the range before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column(0).to_numpy()
            part = np.searchsorted(bounds, did, side="right")
            rows = [np.arange(len(did)), np.flatnonzero(np.isin(did, bounds)), np.flatnonzero(did == least)]
            to = np.concatenate([part, part[rows[1]] - 1, np.full(len(rows[2]), len(bounds))])
            kind = np.repeat([0, 1, 2], [len(x) for x in rows])
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(kind.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["part", "kind", "did", "text"])

    return run


def _pairs(bins: int, size: int):
    def emit(ids: list[int], texts: list[str], after: list[str]) -> pa.RecordBatch:
        edited = []
        for t, nxt in zip(texts, after):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + nxt[:half])
        own, other = low_bits(texts, bins, size), low_bits(edited, bins, size)
        # the next document is the next row but for the last row
        ahead = np.concatenate([own[1:], low_bits(after[-1:], bins, size)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(packed(own)), pa.array(packed(other)),
                pa.array(likeness(own, other)), pa.array(likeness(own, ahead)),
            ],
            ["did", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, chars, closed = None, [], [], 0, False

        def flush(last: str | None):
            """Emit all rows but the last one, or with its next text the last one too."""
            n = len(texts) if last is not None else len(texts) - 1
            if n <= 0:
                return None
            after = [*texts[1:], last] if last is not None else texts[1:]
            return emit(ids[:n], texts[:n], after[:n])

        for batch in batches:
            for p, kind, did, text in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, ids, texts, chars, closed = p, [], [], 0, False
                if kind:
                    if not closed and texts:  # the first one that follows this range
                        yield flush(text)
                    ids, texts, chars, closed = [], [], 0, True
                    continue
                ids.append(did)
                texts.append(text)
                chars += len(text)
                if chars > 1 << 20 and len(texts) > 1:
                    yield flush(None)
                    ids, texts = ids[-1:], texts[-1:]
                    chars = len(texts[0])

    return run


def fingerprints_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, size: int = SIZE, parts: int | None = None) -> DataFrame:
    """Fingerprint each text and its edited text, whose second half is replaced by the start of the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row.
    Documents are dealt to ranges of ids; a range also gets the first document of the next one, so no task sees more
    than its range.

    Null or empty text: no shingles, a fingerprint of zeros, likeness 1 to another such text.  A text of fewer words
    than a shingle is one shingle.  Null ids come before all others; rows with one id follow each other by text.
    A single row is its own next document.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "fingerprints")
    src = docs.select(row_key(F.col(id_col)).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = parts or max(2, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    cuts, least = src.agg(F.percentile_approx("did", [i / parts for i in range(1, parts)], 20 * parts), F.min("did")).first()
    bounds = np.unique(np.array([c for c in cuts or [] if c != least], dtype=np.int64))
    dealt = src.mapInArrow(_route(bounds, least), "part int, kind int, did long, text string")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "kind", "did", "text")
    out = dealt.mapInArrow(_pairs(bins, size), "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(real_id().alias("doc_id"), *out.columns[1:])
