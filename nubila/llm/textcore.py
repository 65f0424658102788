"""Words and their hashes from Arrow string columns, a few passes of numpy over the raw bytes.

A word is a run of bytes outside \\x20 and \\x09-\\x0D.  Hashes are polynomials modulo 2**64 over bytes (words)
or over mixed word hashes (windows), taken as differences of running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at once; a longer document is a chunk of its own.
CHUNK = 1 << 20
P_BYTE, P_WORD = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.arange(1, 257, dtype=U), _LOWER.astype(U) + U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, CHUNK + 64)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, U(b))
            p[0] = U(1)
            made.append(np.multiply.accumulate(p))
        _powers[base] = tuple(made)
    p, q = _powers[base]
    return p[:n], q[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about size bytes."""
    raw, off = column_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; rows (off) and, if given, positions in cut end a word."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z
    solid = ~_SPACE[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    np.logical_not(solid[:-1], out=fresh[1:])
    fresh[off[:-1][off[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    ends = off[1:][off[1:] > 0]
    last[ends - 1] = True
    return np.flatnonzero(solid & fresh), np.flatnonzero(solid & last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, U)
    p, q = powers(P_BYTE, len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(_CODES[lower][data] * p[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


class Words:
    """The words of a chunk of rows: spans, hashes, and at[i]:at[i+1] the words of row i."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data, self.off = data, off
        self.starts, self.ends = word_spans(data, off)
        self.hashes = span_hashes(data, self.starts, self.ends, lower)
        self.at = np.searchsorted(self.starts, off)

    def prefix(self) -> np.ndarray:
        """Running sums for windows(); kept by the caller if it asks for several lengths."""
        p, _ = powers(P_WORD, len(self.hashes) + 1)
        total = np.empty(len(self.hashes) + 1, U)
        total[0] = 0
        np.cumsum(self.hashes * p[:-1], out=total[1:])
        return total

    def joined(self, lo: np.ndarray, hi: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences lo..hi-1."""
        _, q = powers(P_WORD, len(self.hashes) + 1)
        return mix((total[hi] - total[lo]) * q[lo] + (hi - lo).astype(U) * U(0x9FB21C651E98DF25))


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all n-word shingles; a shorter row that has words is one shingle as a whole."""
    count = np.diff(words.at)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), made)
    first = np.cumsum(made) - made
    lo = words.at[:-1][row] + (np.arange(len(row)) - first[row])
    hi = np.minimum(lo + n, words.at[1:][row])
    return row, words.joined(lo, hi, words.prefix())


def distinct_by_row(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row: (offsets by row, values)."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    parts, sizes = [], np.zeros(rows + 1, np.int64)
    for i in range(rows):
        if bounds[i] < bounds[i + 1]:
            v = np.unique(value[bounds[i] : bounds[i + 1]])
            parts.append(v)
            sizes[i + 1] = len(v)
    return np.cumsum(sizes), np.concatenate(parts) if parts else np.zeros(0, U)


def list_array(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """array<bigint> from row offsets and 64-bit values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
