"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded; filters of several widths run over windows of a fixed length; each filter's largest response in a window
goes through a linear layer to one logit per language.  A text is cut into windows that overlap by the widest filter, so every
place of it is seen; its logits are the means over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import real_id, row_key
from .textcore import _LOWER, chunks
from .workspace import tune

#: Widths of filters, filters of each width, length of a byte's embedding, bytes of a window.
WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4, 5), 16, 8, 256
#: The network is fitted on at most this many documents, dealt evenly over the languages, with so many windows of each.
FIT_ROWS, FIT_WINDOWS = 4000, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 4e-3, 11
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Network(NamedTuple):
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (widest * EMBED, number of filters); narrower filters have zeros at the end
    bias: np.ndarray
    out: np.ndarray  # (number of filters, number of languages)
    out_bias: np.ndarray


def _shape() -> tuple[int, int, np.ndarray]:
    """Widest filter, number of filters, and which weights each filter has."""
    widest, count = max(WIDTHS), FILTERS * len(WIDTHS)
    width = np.repeat(WIDTHS, FILTERS)
    return widest, count, (np.repeat(np.arange(widest), EMBED)[:, None] < width).astype(np.float32)


def patches(net: Network, windows: np.ndarray) -> np.ndarray:
    """(windows, places, widest * EMBED): the embedded bytes under the widest filter at each place."""
    widest = max(WIDTHS)
    e = np.ascontiguousarray(net.embed[windows])
    n, length, d = e.shape
    s = e.strides
    return np.lib.stride_tricks.as_strided(e, (n, length - widest + 1, widest * d), (s[0], s[1], s[2]))


def pooled(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each window, before the bias, and all responses."""
    p = patches(net, windows)
    n, places, width = p.shape
    r = (p.reshape(n * places, width) @ net.filters).reshape(n, places, -1)
    return r.max(1), r


def logits(net: Network, windows: np.ndarray, batch: int = 32) -> np.ndarray:
    out = np.zeros((len(windows), len(net.languages)), np.float32)
    for lo in range(0, len(windows), batch):
        h, _ = pooled(net, windows[lo : lo + batch])
        out[lo : lo + batch] = np.maximum(h + net.bias, 0) @ net.out + net.out_bias
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Network:
    """Fit by Adam on cross entropy; windows of bytes (n, WINDOW), y the number of each window's language."""
    rng = np.random.default_rng(seed)
    widest, count, has = _shape()
    draw = lambda *shape: rng.normal(size=shape).astype(np.float32)
    w = [draw(256, EMBED) * 0.5, draw(widest * EMBED, count) * has * np.sqrt(2 / (has.sum(0))).astype(np.float32), np.zeros(count, np.float32), draw(count, len(languages)) * 0.1, np.zeros(len(languages), np.float32)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    steps = max(1, epochs * -(-len(y) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            at = order[lo : lo + BATCH]
            net = Network(languages, *w)
            x, n = windows[at], len(at)
            h, r = pooled(net, x)
            active = h + net.bias
            a = np.maximum(active, 0)
            g = softmax(a @ net.out + net.out_bias)
            g[np.arange(n), y[at]] -= 1
            g /= n
            back = (g @ net.out.T) * (active > 0)
            # only the place of a filter's largest response has a gradient
            place = r.argmax(1)
            under = patches(net, x)[np.arange(n)[:, None], place]
            grads = [np.zeros_like(w[0]), np.einsum("nf,nfk->kf", back, under) * has, back.sum(0), a.T @ g, g.sum(0)]
            spread = (back[:, :, None] * net.filters.T[None]).reshape(n, count, widest, EMBED)
            seen = x[np.arange(n)[:, None, None], place[:, :, None] + np.arange(widest)]
            np.add.at(grads[0], seen.ravel(), spread.reshape(-1, EMBED))
            t += 1
            speed = rate * (1 - (t - 1) / steps) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, d, m1, v1 in zip(w, grads, m, v):
                m1 += 0.1 * (d - m1)
                v1 += 0.001 * (d * d - v1)
                p -= speed * m1 / (np.sqrt(v1) + 1e-8)
    return Network(languages, *w)


def cut(off: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the windows of rows of text; each place of a text is a filter's start in one of them."""
    count = np.maximum(1, -(-np.diff(off) // step))
    row = np.repeat(np.arange(len(off) - 1), count)
    return row, off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step


def read(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of windows, zero beyond their text's end, and how many of them are text."""
    at = start[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8), inside.sum(1)
    return np.where(inside, _LOWER[data[np.minimum(at, len(data) - 1)]], np.uint8(0)), inside.sum(1)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at places all over a text, of several lengths, for training; chosen by the text's own hash."""
    for batch in batches:
        lang, label = [], []
        for key, name, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            rng = np.random.default_rng(key & ((1 << 63) - 1))
            raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
            for i in range(FIT_WINDOWS):
                # short ones too, since texts may be a word long
                size = WINDOW if i % 2 == 0 else int(rng.integers(12, WINDOW))
                at = int(rng.integers(0, max(len(raw) - size, 0) + 1))
                lang.append(raw[at : at + size].tobytes().ljust(WINDOW, b"\0"))
                label.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.binary()), pa.array(label, pa.string())], ["bytes", "lang"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Network | None:
    """Fit on at most ``rows`` documents that have a language and letters: of each language about an equal share, or as many as
    there are, with the least hashes of id and text; repeated rows count once.  None without any such document.

    docs must be without rows that are held out.
    """
    tune(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    known = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = max(1, rows * 19 // 20 // len(languages))
    # a threshold of the hash that about the share stays below; the scan drops the rest before anything moves
    limit = F.create_map(*[F.lit(v) for s in languages for v in (s, min(1 << 32, -(-(1 << 32) * share // max(1, sizes[s]))))])
    some = known.where(F.pmod(F.col("key"), F.lit(1 << 32)) < limit[F.col("lang")])
    some = some.dropDuplicates(["key", "lang"]).orderBy("key", "lang").limit(rows)
    got = some.mapInArrow(_samples, "bytes binary, lang string").orderBy("lang", "bytes").toArrow()
    raw = b"".join(got.column("bytes").to_pylist())
    number = {s: i for i, s in enumerate(languages)}
    y = np.array([number[s] for s in got.column("lang").to_pylist()])
    return train(np.frombuffer(raw, np.uint8).reshape(-1, WINDOW), y, languages)


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = WINDOW - max(WIDTHS) + 1
        for batch in batches:
            lettered = batch.column(0).to_numpy(zero_copy_only=False)
            names, scores = [], []
            for lo, hi, data, off in chunks(batch.column(1)):
                if net is None:
                    names += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                row, start = cut(off, step)
                total, weight = np.zeros((hi - lo, len(net.languages))), np.zeros(hi - lo)
                for k in range(0, len(row), 2048):
                    r = row[k : k + 2048]
                    windows, size = read(data, start[k : k + 2048], off[1:][r])
                    size = np.minimum(size, step)
                    np.add.at(total, r, logits(net, windows) * size[:, None])
                    np.add.at(weight, r, size)
                p = softmax(total / np.maximum(weight, 1)[:, None])
                best = p.argmax(1)
                for i, ok in enumerate(lettered[lo:hi].tolist()):
                    names.append(net.languages[best[i]] if ok else UNKNOWN)
                    scores.append(float(p[i, best[i]]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], ["lang_pred", "score", *batch.schema.names[2:]])

    return run


def predict(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) in the end; only the text is looked at.

    Text that is null or has no letter gives "und" and 0, as does all text where there was nothing to learn from.
    Columns keep their names; columns that are already named lang_pred or score are replaced.
    """
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    out = src.mapInArrow(_predict(net), f"lang_pred string, score double, row {src.schema['row'].dataType.simpleString()}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "lang_pred", "score")


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row: the network learns from rows that aren't held out.

    Null ids stay null and aren't held out; repeated rows are predicted each; other columns are ignored.
    """
    net = fit(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(row_key(F.col(f"`{id_col}`")).alias("did"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return predict(rows, net).select(real_id().alias("doc_id"), "held_out", "lang_pred", "score")
