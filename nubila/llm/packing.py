"""Packing by power-of-two decomposition: no sequence crosses documents, none needs padding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import real_id, row_key
from .workspace import tune

LIMIT, END = 2048, 1
#: How byte-level vocabularies split text before their merges (fixed pattern), and a run of white space that goes to the library.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = re.compile(r"\s{200}")


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    Where the file's merges rank as its ids do and it splits text by the byte-level pattern, tiktoken gives the library's
    ids in a fraction of its time.  Other vocabularies, and texts that hold a special token's string or very long white
    space, go to the library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from .bpe import byte_alphabet

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.loads(self.model.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        back = {c: b for b, c in byte_alphabet().items()}
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        made = [model["vocab"]["".join(m)] for m in model["merges"]]
        plain = model["type"] == "BPE" and not model.get("ignore_merges") and not spec["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not plain or made != sorted(made):
            self.fast = None
            return
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or LONG_SPACE.search(text):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks that a worker process runs."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decompose(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids, longest first; lengths are powers of two, at most limit."""
    pieces, start = [], 0
    while start < n:
        length = min(limit, 1 << ((n - start).bit_length() - 1))
        pieces.append((start, length))
        start += length
    return pieces


def _pieces(path: str, limit: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(path)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            did, start, length, crc, total, ids = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encode(text.as_py() or "") + tail
                n = len(raw) // 4
                for at, size in decompose(n, limit):
                    piece = raw[4 * at : 4 * (at + size)]
                    did.append(key)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(piece)
            arrays = [pa.array(x, pa.int64()) for x in (did, start, length, crc, total)]
            names = ["did", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of length).

    A document's ids and the id ``end`` are cut into pieces whose lengths are the binary digits of their number (as
    many of ``limit`` as fit first).  A piece is a sequence of its own: offset 0, no padding; sequences of one bucket
    have one length and can be batched together.  sequence_id is unique, its high bits name the partition.
    ``limit`` must be a power of two.  ``with_ids`` adds the ids, little-endian unsigned 32-bit.

    Null or empty text: one sequence that holds the end id.  Null ids stay null; repeated rows are packed each.  Other
    columns are ignored.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    tune(docs.sparkSession)
    src = docs.select(row_key(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("text"))
    kind = "did long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    out = src.mapInArrow(_pieces(vocabulary, limit, end, with_ids), kind)
    bucket = F.round(F.log2(F.col("length"))).cast("int")
    return out.select(
        real_id().alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"), *(["ids"] if with_ids else [])
    )
