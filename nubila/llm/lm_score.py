"""Language-model scoring by cross-entropy difference between two matched n-gram models.

Both models are interpolated bigram models over one shared vocabulary, with the same smoothing and the same weights.
The counts cover every word of both tables.

Each word and each pair of words is counted for itself, in tables that grow with the corpus; the vocabulary is the words of
both tables.  Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import from_planes, planes, steps
from .rows import real_id, row_key
from .textcore import U, Words, chunks, mix
from .workspace import Workspace

#: The pairs' weight, and what is added to each word's count.
WEIGHT, ADD = 0.5, 0.1
_START = U(0x2545F4914F6CDD1D)

#: Bytes of text of a block of rows, and words of all blocks for each part of the keys.
BLOCK_BYTES, PART_WORDS = 8 << 20, 2_000_000


_BLOCK = "side int, block long, dids binary, sizes binary, rows long, n_words long, n_distinct long, words binary, seq binary"


def _encoded(side: int):
    """Rows as blocks: ids and numbers of words by row, the hashes of the distinct words, and the places of all words in them."""

    def block(dids: list, sizes: list, hashes: list) -> pa.RecordBatch:
        did, n, h = np.concatenate(dids), np.concatenate(sizes), np.concatenate(hashes)
        distinct, seq = np.unique(h, return_inverse=True)
        values = [side, int.from_bytes(os.urandom(8), "little") >> 1, did.astype("<i8").tobytes(), planes(n), len(did), len(h), len(distinct), steps(distinct), planes(seq)]
        names, kinds = zip(*[x.split(" ") for x in _BLOCK.split(", ")])
        types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([v], types[k]) for v, k in zip(values, kinds)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dids, sizes, hashes, held = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in chunks(batch.column(1)):
                if held and held + len(data) > BLOCK_BYTES:
                    yield block(dids, sizes, hashes)
                    dids, sizes, hashes, held = [], [], [], 0
                words = Words(data, off, lower=True)
                dids.append(ids[lo:hi].copy())
                sizes.append(np.diff(words.at))
                hashes.append(words.hashes)
                held += len(data)
        if dids:
            yield block(dids, sizes, hashes)

    return run


class _Block:
    """A block's distinct words (and the row start) and pairs in the order of their keys, and the places of its words, contexts and pairs."""

    def __init__(self, row: dict):
        self.sizes = from_planes(row["sizes"], row["rows"]).astype(np.int64)
        distinct = np.cumsum(from_planes(row["words"], row["n_distinct"]), dtype=U)
        seq = from_planes(row["seq"], row["n_words"]).astype(np.int64)
        self.words = np.unique(np.append(distinct, _START)) if len(seq) else distinct
        place = np.searchsorted(self.words, distinct)
        self.w = place[seq]
        self.c = np.empty(len(seq), np.int64)
        self.c[1:] = self.w[:-1]
        ends = np.cumsum(self.sizes)
        self.c[(ends - self.sizes)[self.sizes > 0]] = np.searchsorted(self.words, _START)
        h = self.words
        self.pairs, self.p = np.unique(mix(h[self.w] * U(0x9E3779B97F4A7C15) + h[self.c]), return_inverse=True)


#: Kinds of keys: words (counted as words and as contexts) and pairs.
_WORD, _PAIR = 0, 1


def _asked(parts: int):
    """A block's keys and their counts in it, by kind and part of the keys' range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                out = {k: [] for k in ("kind", "part", "side", "block", "n", "keys", "counts")}
                for kind, keys, counts in (
                    (_WORD, b.words, np.stack([np.bincount(b.w, minlength=len(b.words)), np.bincount(b.c, minlength=len(b.words))])),
                    (_PAIR, b.pairs, np.bincount(b.p, minlength=len(b.pairs))[None]),
                ):
                    part = ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)
                    bounds = np.searchsorted(part, np.arange(parts + 1))
                    for i in np.flatnonzero(np.diff(bounds)):
                        lo, hi = bounds[i], bounds[i + 1]
                        for k, v in zip(out, (kind, int(i), row["side"], row["block"], int(hi - lo), steps(keys[lo:hi]), planes(counts[:, lo:hi].ravel()))):
                            out[k].append(v)
                types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return run


def _answers(table: pa.Table) -> pa.Table:
    """The whole counts of a part's keys, for each block of documents in the order of its keys; block -1: the number of words."""
    rows = table.to_pylist()
    kind, part = rows[0]["kind"], rows[0]["part"]
    each = 2 if kind == _WORD else 1
    keys, at = np.unique(np.concatenate([np.cumsum(from_planes(r["keys"], r["n"]), dtype=U) for r in rows]), return_inverse=True)
    total = np.zeros((2, each, len(keys)), np.int64)
    ends = np.cumsum([r["n"] for r in rows])
    for r, end in zip(rows, ends):
        # a block has a key once
        total[1 - r["side"]][:, at[end - r["n"] : end]] += from_planes(r["counts"], each * r["n"]).astype(np.int64).reshape(each, -1)
    flat = total.reshape(2 * each, -1)
    got = [(r["block"], r["n"], planes(flat[:, at[end - r["n"] : end]].ravel())) for r, end in zip(rows, ends) if r["side"] == 0]
    if kind == _WORD:
        got.append((-1, int((total[:, 0].sum(axis=0) > 0).sum()), b""))
    return pa.table({
        "block": pa.array([g[0] for g in got], pa.int64()), "kind": pa.array([kind] * len(got), pa.int32()), "part": pa.array([part] * len(got), pa.int32()),
        "n": pa.array([g[1] for g in got], pa.int64()), "counts": pa.array([g[2] for g in got], pa.binary()),
    })


def _scored(words: int, totals: tuple[int, int], weight: float, add: float):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        by: dict[int, list[dict]] = {_WORD: [], _PAIR: []}
        for r in answers.to_pylist():
            by[r["kind"]].append(r)
        for row in blocks.to_pylist():
            b = _Block(row)
            tables = []
            for kind, each, keys in ((_WORD, 4, b.words), (_PAIR, 2, b.pairs)):
                parts = [from_planes(r["counts"], each * r["n"]).reshape(each, -1) for r in sorted(by[kind], key=lambda r: r["part"])]
                tables.append(np.concatenate(parts, axis=1).astype(float) if parts else np.zeros((each, 0)))
                if tables[-1].shape[1] != len(keys):
                    raise ValueError(f"{len(keys)} keys of a block, but {tables[-1].shape[1]} counts")
            ends, n = np.cumsum(b.sizes), b.sizes
            means = []
            for i in range(2):
                alone = (tables[0][2 * i][b.w] + add) / (totals[i] + add * words)
                bits = -np.log2(weight * tables[1][i][b.p] / np.maximum(tables[0][2 * i + 1][b.c], 1) + (1 - weight) * alone)
                total = np.concatenate([[0.0], np.cumsum(bits)])
                means.append(np.where(n > 0, (total[ends] - total[ends - n]) / np.maximum(n, 1), np.nan))
            arrays = [pa.array(m, from_pandas=True) for m in (*means, means[0] - means[1])]
            out.append(pa.table([pa.array(np.frombuffer(row["dids"], "<i8")), pa.array(n), *arrays], ["did", "n_tokens", "target_bits", "background_bits", "score"]))
        kinds = pa.schema([("did", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.float64()) for c in ("target_bits", "background_bits", "score")]])
        return pa.concat_tables(out) if out else kinds.empty_table()

    return run


def counted_difference(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", weight: float = WEIGHT, add: float = ADD) -> DataFrame:
    """(doc_id, n_tokens, target_bits, background_bits, score), one row per row of docs.

    target_bits and background_bits are mean losses per token under a model of ``target`` and one of ``docs``; score is their
    difference, lower for documents that are more like the target.  ``add`` goes to each word of either table.

    Null or empty text, or text without words: n_tokens 0 and null losses.  Null ids stay null; repeated rows count and
    are scored each.  An empty target gives a model that knows no word: all losses alike.  Other columns are ignored.

    Both tables are written once as blocks of word numbers.  A block sends each of its distinct words and pairs with
    its count to the part of the keys' range that it falls in, and gets the whole counts back in the same order, so a common
    word is one entry of a block.  Blocks have a size; their number and that of the parts grow with the input.
    """
    ws = Workspace(docs.sparkSession, "lm")
    src = docs.select(row_key(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("text"))
    aim = target.select(F.lit(0).cast("long").alias("did"), F.col(target_col).cast("string").alias("text"))
    blocks = ws.save(src.mapInArrow(_encoded(0), _BLOCK).unionByName(aim.mapInArrow(_encoded(1), _BLOCK)), "blocks")
    sums = {r.side: r.n for r in blocks.groupBy("side").agg(F.sum("n_words").alias("n")).collect()}
    totals = sums.get(1, 0), sums.get(0, 0)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, -(-sum(totals) // PART_WORDS))
    asked = blocks.mapInArrow(_asked(parts), "kind int, part int, side int, block long, n long, keys binary, counts binary")
    answers = ws.save(asked.groupBy("kind", "part").applyInArrow(_answers, "block long, kind int, part int, n long, counts binary"), "answers")
    ws.release()
    words = answers.where("block = -1").agg(F.sum("n")).first()[0] or 0
    score = _scored(max(words, 1), totals, weight, add)
    out = blocks.where("side = 0").groupBy("block").cogroup(answers.where("block <> -1").groupBy("block")).applyInArrow(score, "did long, n_tokens long, target_bits double, background_bits double, score double")
    return out.select(real_id().alias("doc_id"), *out.columns[1:])
