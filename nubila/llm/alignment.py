"""Alignment of two tokenizers' tokens: shared cuts of packed bitsets, and links of tokens whose bytes overlap.

A token's end is a bit at its last byte.  AND of both sides' bitsets gives the places where both end a token; popcounts of words
and of the bits below a place (rank) turn byte places into numbers of tokens, the set bits' places (select) are the cuts.
The links of a token to the other side's are the range between the ranks at its first and last byte.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import from_planes, planes
from .rows import real_id, row_key
from .textcore import U
from .workspace import Workspace

#: Bytes of text that are aligned at once and of a block of rows; segments that a worker remembers, and letters of one from which on it is not kept.
CHUNK, BLOCK, REMEMBER, LONG = 1 << 20, 8 << 20, 300_000, 400
#: Single spaces between other characters: both tokenizers start a token there.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Bits:
    """A set of places below ``size``, 64 to a word, with ranks."""

    def __init__(self, places: np.ndarray, size: int):
        flags = np.zeros((size // 64 + 1) * 64, bool)
        flags[places] = True
        self.words = np.packbits(flags, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many places of the set are below each place."""
        word, bit = at >> 6, (at & 63).astype(U)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U(1) << bit) - U(1)))


def select(words: np.ndarray) -> np.ndarray:
    """The places of a bitset."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


class Aligned:
    """Groups and links of tokens with these byte lengths; both sides have the same bytes altogether."""

    def __init__(self, a_len: np.ndarray, b_len: np.ndarray):
        self.a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
        size = int(self.a_end[-1]) if len(a_len) else 0
        a, b = Bits(self.a_end - 1, size), Bits(b_end - 1, size)
        #: Byte places where both end a token, and the numbers of tokens up to there.
        self.cuts = select(a.words & b.words) + 1
        self.a_cut, self.b_cut = a.rank(self.cuts), b.rank(self.cuts)
        #: The first and last token of B that each token of A overlaps.
        self.first, self.last = b.rank(self.a_end - a_len), b.rank(self.a_end - 1)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that share a byte, by their numbers."""
        n = self.last - self.first + 1
        a = np.repeat(np.arange(len(n)), n)
        return a, self.first[a] + np.arange(len(a)) - (np.cumsum(n) - n)[a]


class Pair:
    """Both tokenizers: ids of whole texts, and the bytes and decimal names of tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        from .bpe import byte_alphabet
        from .packing import Encoder

        self.library = Tokenizer.from_file(path_a)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        self.fast = Encoder(path_a).fast
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in byte_alphabet().items()}
        named = self.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        piece = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Whether texts may be cut at single spaces: no piece of B crosses one, A's pattern starts anew there.
        self.cuts = self.fast is not None and not any("▁" in p.lstrip("▁") for p in piece)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def ids_a(self, text: str) -> list[int]:
        # the fast splitter takes long over long white space
        return self.fast.encode_ordinary(text) if self.fast is not None and len(text) < LONG else self.library.encode(text, add_special_tokens=False).ids

    def learn(self, parts: list[str]) -> None:
        for s, b in zip(parts, self.b.encode(parts, num_threads=1)):
            a, whole = self.ids_a(" " + s), (" " + s).encode()
            same = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
            self.known[s] = (np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if same else None

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """A's ids of space and text and B's ids of the text, 32 bits each; none if the bytes of either are not the text's."""
        parts = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = {s for p in parts for s in p if s not in self.known}
        self.learn(list(new))
        out, known = [], self.known
        for p in parts:
            got = [known[s] for s in p]
            out.append((b"", b"") if None in got else (b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        for s in new:
            if len(s) >= LONG:
                del known[s]
        return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """One pair for all tasks that a worker process runs."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _names(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..size-1, filled up with zero bytes, with room for a separator; and their numbers."""
    text = np.arange(size).astype(f"S{len(str(size))}")
    digits = np.zeros((size, len(str(size)) + 1), np.uint8)
    digits[:, :-1] = text.view(np.uint8).reshape(size, -1)
    return digits, np.char.str_len(text)


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def group_texts(al: Aligned, a: np.ndarray, b: np.ndarray, rows: np.ndarray, size: int) -> tuple[bytes, np.ndarray]:
    """The text `a1,a2|b1;a3|b2` of all groups, and where each row's ends; rows are numbers of groups up to each row's end."""
    if size not in _DIGITS:
        _DIGITS[size] = _names(size)
    digits, length = _DIGITS[size]
    group_a, group_b = np.diff(al.a_cut, prepend=0), np.diff(al.b_cut, prepend=0)
    groups = np.arange(len(al.cuts))
    # a group's tokens of A stand before those of B
    at_a = np.arange(len(a)) + np.repeat(al.b_cut - group_b, group_a)
    at_b = np.arange(len(b)) + np.repeat(al.a_cut, group_b)
    code, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    code[at_a], code[at_b] = a, b
    sign[at_a[al.a_cut[groups] - 1]] = ord("|")
    sign[at_b[al.b_cut[groups] - 1]] = ord(";")
    ends = (al.a_cut + al.b_cut)[rows[rows > 0] - 1]
    sign[ends - 1] = 0  # a row's last group has no separator
    table = digits[code]
    table[np.arange(len(code)), length[code]] = sign
    total = np.concatenate([[0], np.cumsum(length[code] + (sign > 0))])
    until = np.zeros(len(rows), np.int64)
    until[rows > 0] = total[ends]
    return table[table > 0].tobytes(), until


class _Block:
    """Rows of a block: results by row, and the distinct id pairs of each row with their numbers of links."""

    def __init__(self, names: bool):
        self.did, self.n, self.sha, self.text, self.names = [], [], [], [], names
        self.keys, self.times, self.sizes = [], [], []

    def add(self, did: np.ndarray, got: list[tuple[bytes, bytes]], pair: Pair) -> None:
        a, b = (np.frombuffer(b"".join([g[i] for g in got]), "<i4").astype(np.int64) for i in range(2))
        n_a, n_b = (np.array([len(g[i]) // 4 for g in got], np.int64) for i in range(2))
        row_a = np.repeat(np.arange(len(got)), n_a)
        al = Aligned(pair.a_len[a], pair.b_len[b])
        ends_a = np.cumsum(n_a)
        # every row's end is a cut
        groups = np.searchsorted(al.a_cut, ends_a, side="right")
        link_a, link_b = al.links()
        n_links = np.bincount(row_a, (al.last - al.first + 1), len(got)).astype(np.int64)
        self.did.append(did)
        self.n.append(np.stack([n_a, n_b, np.diff(groups, prepend=0), n_links]))
        text, until = group_texts(al, a, b, groups, max(len(pair.a_bytes), len(pair.b_bytes)))
        begin = 0
        for n, end in zip(n_a.tolist(), until.tolist()):
            self.sha.append(hashlib.sha256(text[begin:end]).hexdigest() if n else "")
            if self.names:
                self.text.append(text[begin:end].decode() if n else "")
            begin = max(begin, end)
        # distinct (row, A id, B id) with their numbers, in order
        width = len(pair.b_bytes)
        span = len(pair.a_bytes) * width
        key = np.sort(row_a[link_a] * span + a[link_a] * width + b[link_b])
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.times.append(np.diff(new, append=len(key)))
        row, value = np.divmod(key[new], span)
        self.keys.append(value)
        self.sizes.append(np.bincount(row, minlength=len(got)))

    def batch(self) -> pa.RecordBatch:
        keys = np.concatenate(self.keys)
        distinct, seq, docs = np.unique(keys, return_inverse=True, return_counts=True)
        did, n = np.concatenate(self.did), np.concatenate(self.n, axis=1)
        values = [int.from_bytes(os.urandom(8), "little") >> 1, len(did), did.astype("<i8").tobytes(), planes(n.ravel()), self.sha, self.text, len(keys), planes(np.concatenate(self.sizes)), planes(seq), planes(np.concatenate(self.times)), distinct, docs]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], _NAMES)


_BLOCK = "block long, rows int, dids binary, n binary, sha array<string>, groups array<string>, n_pairs int, sizes binary, seq binary, times binary, pairs array<bigint>, docs array<bigint>"
_NAMES = [c.split(" ")[0] for c in _BLOCK.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}[c.split(" ")[1]] for c in _BLOCK.split(", ")]


def _aligned(path_a: str, path_b: str, names: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        block, held = _Block(names), 0
        dids, texts, size = [], [], 0

        def flush() -> None:
            nonlocal dids, texts, size
            block.add(np.array(dids, np.int64), pair.encode(texts), pair)
            dids, texts, size = [], [], 0

        for batch in batches:
            for did, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                dids.append(did)
                texts.append(text)
                size += len(text)
                held += len(text) + 64
                if size >= CHUNK:
                    flush()
                if held >= BLOCK:
                    if dids:
                        flush()
                    yield block.batch()
                    block, held = _Block(names), 0
        if dids:
            flush()
        if block.did:
            yield block.batch()

    return run


def _summed(names: bool):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if answers.num_rows:
            at = np.argsort(answers.column("at").to_numpy())
            count, best = (answers.column(c).to_numpy()[at].astype(np.int64) for c in ("n", "best"))
        r = blocks.to_pylist()[0]
        rows, m = r["rows"], r["n_pairs"]
        if len(count) != len(r["pairs"]):
            raise ValueError(f"{len(r['pairs'])} pairs of a block, but {len(count)} counts")
        sizes, seq, times = (from_planes(r[c], k).astype(np.int64) for c, k in (("sizes", rows), ("seq", m), ("times", m)))
        ends = np.cumsum(sizes)
        total = lambda v: (t := np.concatenate([[0], np.cumsum(v)]))[ends] - t[ends - sizes]
        n = from_planes(r["n"], 4 * rows).astype(np.int64).reshape(4, rows)
        columns = [np.frombuffer(r["dids"], "<i8"), *n, total(times * best[seq]), total(times * count[seq])]
        out = [pa.array(c, pa.int64()) for c in columns] + [pa.array(r["sha"], pa.string())] + ([pa.array(r["groups"], pa.string())] if names else [])
        return pa.table(out, ["did", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if names else [])])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of docs.

    A's ids are those of the tokenizers library's file ``path_a`` (byte-level) for a space and the text, special tokens' strings
    being plain text; B's those of the sentencepiece model ``path_b`` for the text.  Groups lie between the places where both end a
    token; links are all pairs of an A and a B token that share a byte.  An id pair's count is the number of rows that have it
    linked; n_best are a row's links whose count is the highest of their A id, count_sum is the counts' sum over its links.
    ``with_groups`` adds the groups as text, `a1,a2|b1;a3|b2,b3`.

    Null or empty text, and text whose bytes the joined tokens of either side don't give back, has no tokens: zeros and an
    empty digest.  Null ids stay null; repeated rows count each; other columns are ignored.

    Blocks of rows are written once with their distinct pairs.  Counts are one aggregation over these, combined in the map
    tasks first; the counts go back to the blocks by a join on the pair, in which a block has each of its pairs once.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "align")
    width = len(pair_of(path_a, path_b).b_bytes)
    src = docs.select(row_key(F.col(f"`{id_col}`")).alias("did"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = ws.save(src.mapInArrow(_aligned(path_a, path_b, with_groups), _BLOCK), "blocks")
    each = blocks.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"))
    counts = ws.save(each.withColumn("a", F.expr(f"pair div {width}")), "counts")
    # a row for each id of A
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    ranked = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    asked = blocks.select(F.col("block").alias("asking"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(ranked, "pair").select("asking", "at", "n", "best")
    kind = "did long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if with_groups else "")
    out = blocks.drop("docs").groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(_summed(with_groups), kind)
    return out.select(real_id().alias("doc_id"), *out.columns[1:])
