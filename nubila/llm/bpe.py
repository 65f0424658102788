"""BPE encoding and decoding of whole texts; words of a batch are encoded together on a trie.

Of a prefix of a word, only the last token of its encoding is kept.  The encoding of a prefix that ends in token t is
the encoding of what stands before t, plus t, where t may follow that encoding's last token: where merging the two
strings anew would leave just those two tokens.  One token qualifies for each prefix.  So a depth-first walk over the
trie of distinct words hands last tokens down, and a prefix that words share is worked out once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import real_id, row_key
from .workspace import tune

#: Words and token pairs that a worker remembers before it starts anew; letters of a word from which on the library encodes it.
REMEMBER, LONG = 400_000, 1000
#: Texts of these characters alone are lower-cased and split here; for others the library's normaliser and splitter are used.
_PLAIN = regex.compile("[\x09-\x0d\x20-\x7e\xa1-ɏ]*")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    spare = (chr(256 + i) for i in range(256))
    return {b: table[b] if b in table else next(spare) for b in range(256)}


class TrieEncoder:
    """Encoder for a byte-level BPE vocabulary file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.name = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(map(tuple, model["merges"])):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[x, y] = r
            self.parts.setdefault(z, (x, y, r))
        self.longest = max(map(len, self.ids))
        self.latin = byte_alphabet()
        named = {**self.name, **{i: s for s, i in self.special.items()}}
        self.text = np.array([named.get(i) for i in range(max(named) + 1)], object)
        self.known: dict[str, tuple[bytes, int]] = {}
        self.may: dict[tuple[int, int], bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(token, rank it is made at, rank it is used up at) along the left (0) or right (1) edge of a token."""
        out, used = [], 1 << 60
        while token in self.parts:
            made = self.parts[token][2]
            out.append((token, made, used))
            token, used = self.parts[token][side], made
        return [*out, (token, -1, used)]

    def follows(self, a: int, b: int) -> bool:
        """Whether merging a's and b's strings together leaves the tokens a, b: no merge across them comes first."""
        found = self.may.get((a, b))
        if found is None:
            rank = self.rank
            found = True
            right = self.spine(b, 0)
            for x, made_x, used_x in self.spine(a, 1):
                for y, made_y, used_y in right:
                    q = rank.get((x, y))
                    # of equal merges the left one comes first
                    if q is not None and made_x < q < used_x and made_y < q <= used_y:
                        found = False
                        break
                if not found:
                    break
            if len(self.may) > REMEMBER:
                self.may.clear()
            self.may[a, b] = found
        return found

    def last(self, path: str, depth: int, states: list[int], end: str) -> int:
        """The last token of the encoding of path[:depth] (with the word's end), or -1 if no token qualifies."""
        ids, may = self.ids, self.may
        # one token qualifies, mostly a short one
        for before in range(depth - 1, max(depth - self.longest, 0) - 1, -1):
            token = ids.get(path[before:depth] + end)
            if token is None:
                continue
            if before == 0:
                return token
            pair = (states[before], token)
            if pair[0] >= 0 and (may[pair] if pair in may else self.follows(*pair)):
                return token
        return -1

    def learn(self, words: list[str]) -> None:
        """Encode distinct words on one trie: in sorted order, the walk goes on below the prefix shared with the word before."""
        table = self.latin
        states = [0] * (max(map(lambda w: 4 * len(w), words), default=0) + 2)
        path = ""
        for mapped, word in sorted([(word.encode().decode("latin-1").translate(table), word) for word in words]):
            before, path = path, mapped[:-1]
            depth, shared = 0, min(len(before), len(path))
            while depth < shared and before[depth] == path[depth]:
                depth += 1
            for depth in range(depth + 1, len(mapped)):
                states[depth] = self.last(path, depth, states, "")
            self.known[word] = self.finish(word, mapped, states)

    def finish(self, word: str, mapped: str, states: list[int]) -> tuple[bytes, int]:
        token = self.last(mapped, len(mapped), states, self.end)
        if token < 0:  # a symbol that the vocabulary lacks
            e = self.library.encode(word, add_special_tokens=False)
            return b"".join(i.to_bytes(4, "little") for i in e.ids), len(e.ids)
        out = [token]
        at = len(mapped) - (len(self.name[token]) - len(self.end))
        while at > 0:
            out.append(states[at])
            at -= len(self.name[states[at]])
        out.reverse()
        return b"".join([i.to_bytes(4, "little") for i in out]), len(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian, 32 bits each), special tokens kept; ids that name no token are left out."""
        at = np.frombuffer(ids, "<u4")
        # the vocabulary names no decoder: tokens are joined by one space
        return " ".join([t for t in self.text[at[at < len(self.text)]].tolist() if t is not None])

    def words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        # the library's own splitter: its tables of letters and digits are those of its Unicode version
        text = self.library.normalizer.normalize_str(text)
        return [text[lo:hi] for _, (lo, hi) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[str]:
        if self.split_special is None or "<|" not in text and not any(s in text for s in self.special):
            return [text]
        return [s for s in self.split_special.split(text) if s]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str, int]]:
        """(ids as little-endian 32-bit, decoded text, number of ids) of each text."""
        cut = [[[s] if s in self.special else self.words(s) for s in self.segments(t)] for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = {w for t in cut for s in t for w in s if w not in self.known}
        new.difference_update(self.special)
        for s, i in self.special.items():
            self.known[s] = (i.to_bytes(4, "little"), 1)
        long = {w for w in new if len(w) >= LONG}
        self.learn(list(new - long))
        known = self.known
        for w in long:
            ids = self.library.encode(w, add_special_tokens=False).ids
            known[w] = (np.array(ids, "<u4").tobytes(), len(ids))
        out = []
        for t in cut:
            got = [known[w] for s in t for w in s]
            ids = b"".join([g[0] for g in got])
            out.append((ids, self.decode(ids), sum([g[1] for g in got])))
        for w in long:
            del known[w]
        return out


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder_of(path: str) -> TrieEncoder:
    """One encoder for all tasks that a worker process runs."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def _encode(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 256):
                got = encoder.encode_batch(texts[lo : lo + 256])
                arrays = [
                    batch.column(0).slice(lo, 256), pa.array([g[2] for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[0]).hexdigest() for g in got]), pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got]),
                ]
                names = ["did", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    arrays += [pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            text = [None if x is None else encoder.decode(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), *batch.columns[1:]], ["decoded", *batch.schema.names[1:]])

    return run


def decode(rows: DataFrame, vocabulary: str, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with the text of their ids (binary, as encode_decode() with ``full`` returns) as column ``to`` in the end.

    Null ids give null text, no ids an empty one; a column that is already named so is replaced.
    """
    tune(rows.sparkSession)
    rest = [c for c in rows.columns if c != to]
    src = rows.select(F.col(f"`{ids_col}`").alias("ids"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    out = src.mapInArrow(_decode(vocabulary), f"decoded string, row {src.schema['row'].dataType.simpleString()}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("decoded").alias(to))


def encode_decode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row; ``full`` adds ids (binary) and decoded.

    Ids are those of the tokenizers library without added special tokens, decoded those of its decode() with special
    tokens kept.  Null text counts as empty: no ids.  Null ids stay null; repeated rows are encoded each; other columns
    are ignored.
    """
    tune(docs.sparkSession)
    src = docs.select(row_key(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_encode(vocabulary, full), "did long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if full else ""))
    return out.select(real_id().alias("doc_id"), *out.columns[1:])
