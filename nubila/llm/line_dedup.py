"""Removal of lines that resemble an earlier line: an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import slot_counts
from .packed import from_planes, planes, steps
from .rows import keyed, real_id
from .textcore import U, chunks, mix, span_hashes, word_spans
from .workspace import KeyFilter, Workspace

#: Slots of the table of token counts that the order of rarity comes from.
SLOTS = 1 << 21
#: Bytes of text that are taken at once: what is made of them stays in a core's cache.
TEXT = 1 << 17


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(20)).astype(np.int64) & (SLOTS - 1)


def _count(batch: pa.RecordBatch, total: np.ndarray) -> None:
    slots = [_slot(span_hashes(data, *word_spans(data, off), lower=True)) for _, _, data, off in chunks(batch.column(0), TEXT)]
    if slots:
        total += np.bincount(np.concatenate(slots), minlength=SLOTS)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Ranks 0..255 of slots: 0 where at most one token occurs at all, then by the logarithm of the count."""
    return np.where(counts <= 1, 0, np.minimum(255, 8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def line_tokens(data: np.ndarray, off: np.ndarray, ranks: np.ndarray):
    """The lines that have words: row, number within the row, offsets, and distinct tokens, rarest first.

    A token is its rank and 56 bits of its hash; it is the same in all lines, so the order is one total order.
    """
    starts, ends = word_spans(data, off)
    h = span_hashes(data, starts, ends, lower=True)
    # lines begin at rows and after line ends
    breaks = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([off[:-1], breaks + 1]))
    words = np.searchsorted(starts, cut)
    line = np.repeat(np.arange(len(cut)), np.diff(np.append(words, len(starts))))
    token = ranks[_slot(h)].astype(U) << U(56) | h >> U(8)
    line, token = _by_line(line, token)
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
    line, token = line[new], token[new]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    begin = cut[line[first]]
    row = np.searchsorted(off, begin, side="right") - 1
    number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, off[row])
    return row, number, np.append(first, len(line)), token


def _by_line(line: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by line, then token."""
    if len(line) and line[-1] < 1 << 16:
        key = line.astype(U) << U(48) | token >> U(16)
        order = np.argsort(key)
        key, sorted_token = key[order], token[order]
        if not ((key[1:] == key[:-1]) & (sorted_token[1:] != sorted_token[:-1])).any():
            return (key >> U(48)).astype(np.int64), sorted_token
    order = np.lexsort((token, line))
    return line[order], token[order]


def class_hashes(at: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line's set of tokens."""
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        total = np.zeros(len(token) + 1, U)
        np.cumsum(mix(token ^ U(salt)), out=total[1:])
        out.append(mix(total[at[1:]] - total[at[:-1]]))
    return out[0], out[1]


def signatures(at: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit of 128 for each token of a line: two sets differ in at least as many tokens as their bits do."""
    bit = token >> U(3) & U(127)
    one = U(1) << (bit & U(63))
    low = np.where(bit < U(64), one, U(0))
    if not len(token):
        return low, low
    return np.bitwise_or.reduceat(low, at[:-1]), np.bitwise_or.reduceat(one ^ low, at[:-1])


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Two sets of similarity 3/4 or more share a token among this many of the rarest tokens of each."""
    return n - (3 * n + 3) // 4 + 1


#: Numbers of a line or class: its (first) place, its lines, the hashes of its set, size and signature of the set, and
#: how many tokens of its prefix follow the first ``skip`` ones, which occur once and join nothing.
_FIELDS = ("did", "th", "line", "copies", "c1", "c2", "n", "s1", "s2", "skip", "size")
_CLASSES = "part int, rows long, " + ", ".join(f"{f} binary" for f in _FIELDS) + ", prefix long, tokens binary"
_PLACE = "did long, th long, line int, c1 long, c2 long"
_POSTED = ("rows", "did", "c1", "n", "s1", "s2", "skip", "size", "prefix", "tokens")
_BRIEF = ("rows", "did", "th", "line", "c1", "c2", "n", "copies")
#: Lines that a task groups before it sends them on, classes in a packed row, and tokens of the lines of one part.
HELD, PACKED, LOAD = 1 << 16, 1 << 14, 1 << 21


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin .. begin + size - 1 of each entry, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _taken(t: dict, rows: np.ndarray) -> dict:
    begin = np.cumsum(t["size"]) - t["size"]
    return {**{f: t[f][rows] for f in _FIELDS}, "tokens": t["tokens"][_spread(begin[rows], t["size"][rows])]}


def _joined(tables: list[dict]) -> dict:
    return {f: np.concatenate([t[f] for t in tables]) for f in tables[0]}


def _grouped(t: dict) -> dict:
    """A row per class: its first place and the number of its lines."""
    order = np.argsort(t["c1"])
    c1 = t["c1"][order]
    # equal hashes are sorted on
    same = np.zeros(len(c1) + 1, bool)
    same[1:-1] = c1[1:] == c1[:-1]
    some = np.flatnonzero(same[1:] | same[:-1])
    rows = order[some]
    order[some] = rows[np.lexsort((t["line"][rows], t["th"][rows], t["did"][rows], t["c2"][rows], c1[some]))]
    c2 = t["c2"][order]
    begin = np.flatnonzero(np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]))
    return {**_taken(t, order[begin]), "copies": np.add.reduceat(t["copies"][order], begin)}


def _pack(t: dict, part: int) -> dict:
    return {"part": part, "rows": len(t["c1"]), **{f: planes(t[f].view(U)) for f in _FIELDS if f in t}, "prefix": len(t.get("tokens", ())), "tokens": planes(t["tokens"]) if "tokens" in t else None}


def _unpack(row: dict) -> dict:
    t = {f: from_planes(row[f], row["rows"]).view(np.int64) for f in _FIELDS if f in row}
    if "tokens" in row:
        t["tokens"] = from_planes(row["tokens"], row["prefix"])
    return t


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split(" ") for x in _CLASSES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in names], [name for name, _ in names])


def _lines(shared, parts: int):
    """Packed rows: places and class hashes of all lines (part -1), and the classes among them, dealt to parts by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, classes, held = [], [], 0
        for batch in batches:
            did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, data, off in chunks(batch.column(2), TEXT):
                row, number, at, token = line_tokens(data, off, shared.value)
                if not len(row):
                    continue
                n = np.diff(at)
                rare = np.concatenate([[0], np.cumsum(token >> U(56) == 0)])
                skip = rare[at[1:]] - rare[at[:-1]]
                size = np.maximum(prefix_length(n) - skip, 0)
                hashes = [x.view(np.int64) for x in (*class_hashes(at, token), *signatures(at, token))]
                columns = (did[lo + row], th[lo + row], number.astype(np.int64), np.ones(len(n), np.int64), *hashes[:2], n, *hashes[2:], skip, size)
                t = dict(zip(_FIELDS, columns), tokens=token[_spread(at[:-1] + skip, size)])
                places.append({f: t[f] for f in ("did", "th", "line", "c1", "c2")})
                classes.append(t)
                held += len(n)
                if held >= HELD:
                    yield flush(places, classes)
                    places, classes, held = [], [], 0
        if held:
            yield flush(places, classes)

    def flush(places: list[dict], classes: list[dict]) -> pa.RecordBatch:
        out = [_pack({f: np.concatenate([t[f] for t in places]) for f in places[0]}, -1)]
        t = _grouped(_joined(classes))
        part = (mix(t["c1"].view(U)) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        out += [_pack(_taken(t, order[bounds[k] : bounds[k + 1]]), int(k)) for k in np.flatnonzero(np.diff(bounds))]
        return _arrow(out)

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of classes, from packed rows that come sorted by part."""

    def packed(held: list[dict]) -> Iterator[pa.RecordBatch]:
        t = _grouped(_joined(held))
        for lo in range(0, len(t["c1"]), PACKED):
            yield _arrow([_pack(_taken(t, np.arange(lo, min(lo + PACKED, len(t["c1"])))), 0)])

    now, held, size = None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now and held:
                yield from packed(held)
                held, size = [], 0
            now = row["part"]
            held.append(_unpack(row))
            size += row["rows"]
            if size > PART:  # copies from many tasks
                held = [_grouped(_joined(held))]
                size = max(0, len(held[0]["c1"]) - PART)
    if held:
        yield from packed(held)


def _told(keys: KeyFilter | None, copied: bool):
    """The classes that the filter lets through and, with copied, those of several lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _unpack(row)
                keep = (t["copies"] > 1) & copied
                if keys is not None:
                    keep |= keys.test(t["c1"])
                t["line"] = t["line"].astype(np.int32)
                names = ("did", "th", "line", "c1", "c2", "n", "copies")
                yield pa.RecordBatch.from_arrays([pa.array(t[f][keep]) for f in names], list(names))

    return run


def _spots(keys: KeyFilter):
    """The places of lines whose class the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _unpack(row)
                keep = keys.test(t["c1"])
                t["line"] = t["line"].astype(np.int32)
                names = ("did", "th", "line", "c1", "c2")
                yield pa.RecordBatch.from_arrays([pa.array(t[f][keep]) for f in names], list(names))

    return run


def _load(batch: pa.RecordBatch, total: np.ndarray) -> None:
    slots = [_token_slot(from_planes(row["tokens"], row["prefix"])) for row in batch.to_pylist()]
    if slots:
        total += np.bincount(np.concatenate(slots), minlength=SLOTS)


def _token_slot(token: np.ndarray) -> np.ndarray:
    return (token >> U(12)).astype(np.int64) & (SLOTS - 1)


#: Postings of one part, and of one token that are compared at once; the blocks of a larger token meet pairwise.
PART, BLOCK = 1 << 19, 1 << 20
#: Candidates per line and token that the first round brings together, and times those of all rounds before in each later one.
FIRST, MORE = 16, 63
#: Pairs of postings that a task holds at once.
PAIRS = 1 << 21
ASKS, ASKED = 1, 2
#: Shares of the tokens whose postings are shuffled one after the other, so that the disk holds one share at a time.
SHARES = 2
_PACKED = "part int, n long, token binary, block binary, c1 binary, did binary, size binary, at binary, s1 binary, s2 binary, role binary"


def _dealt(parts: int, share: int, shares: int, blocks, asking=None, wanted=None):
    """Postings of a share of the classes' prefix tokens, packed by part.

    blocks: for each slot, in how many blocks its tokens' postings are compared.  asking and
    wanted: filters of the classes that ask and of the tokens that they have; without them every class asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):  # together, so that what goes to a part is packed in few pieces
                yield deal(_joined([_unpack(packed) for packed in batch.to_pylist()]))

    def deal(t: dict) -> pa.RecordBatch:
        c1, did, n, s1, s2, skip, size = (t[f] for f in ("c1", "did", "n", "s1", "s2", "skip", "size"))
        token = t["tokens"]
        mine = mix(token) % U(shares) == U(share)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + skip[row]
        token, row, at = token[mine], row[mine], at[mine]
        if wanted is not None:
            keep = wanted.test(token.view(np.int64))
            token, row, at = token[keep], row[keep], at[keep]
        width = blocks.value[_token_slot(token)].astype(np.int64)
        asks = asking.test(c1)[row] if asking is not None else np.ones(len(row), bool)
        # of a token in several blocks, an asking posting goes to the pairs of blocks (own, any) and an asked one to (any, own)
        own = (mix(c1.view(U)[row]) % width.astype(U)).astype(np.int64)
        whole = np.flatnonzero(width == 1)
        which, block, role = [whole], [np.zeros(len(whole), np.int64)], [np.where(asks[whole], ASKS | ASKED, ASKED)]
        for kind, some in ((ASKS, np.flatnonzero((width > 1) & asks)), (ASKED, np.flatnonzero(width > 1))):
            times = width[some]
            i = np.repeat(some, times)
            other = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            which.append(i)
            block.append(own[i] * width[i] + other if kind == ASKS else other * width[i] + own[i])
            role.append(np.full(len(i), kind))
        i, block, role = np.concatenate(which), np.concatenate(block), np.concatenate(role)
        part = (mix(token[i] + block.astype(U)) % U(parts)).astype(np.int64)
        order = np.argsort(token[i])
        # numbers of 16 bits are sorted by digits
        order = order[np.argsort(part[order].astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")]
        i, block, role, part = i[order], block[order], role[order], part[order]
        r = row[i]
        bounds = np.searchsorted(part, np.arange(parts + 1))
        out = {k.split(" ")[0]: [] for k in _PACKED.split(", ")}
        columns = (block, c1[r], did[r], n[r], at[i], s1[r], s2[r], (ASKS | ASKED) - role)
        for k in np.flatnonzero(np.diff(bounds)):
            cut = slice(bounds[k], bounds[k + 1])
            packed = (steps(token[i[cut]]), *[planes(x[cut].astype(np.int64).view(U)) for x in columns])
            for name, v in zip(out, (int(k), int(bounds[k + 1] - bounds[k]), *packed)):
                out[name].append(v)
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k.split(" ")[1]]) for v, k in zip(out.values(), _PACKED.split(", "))], list(out))

    return run


#: Pairs of one token from which on its postings are bucketed by signature, and postings of a bucket up to which all its pairs are listed.
CROWD, BUCKET = 1 << 18, 64


class Postings:
    """Postings as columns, sorted by token and size n, and the tests that a pair must pass."""

    def __init__(self, c1: np.ndarray, did: np.ndarray, n: np.ndarray, at: np.ndarray, s1: np.ndarray, s2: np.ndarray, role: np.ndarray):
        self.c1, self.did, self.n, self.at, self.s1, self.s2, self.role = c1, did, n, at, s1, s2, role

    def fitting(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, x asking and y in no later a document, that size, place and signature let be similar."""
        n, at, s1, s2, did, c1, role = self.n, self.at, self.s1, self.s2, self.did, self.c1, self.role
        for test in (
            lambda: 7 * np.minimum(n[x] - at[x], n[y] - at[y]) >= 3 * (n[x] + n[y]),
            lambda: 7 * (np.bitwise_count(s1[x] ^ s1[y]).astype(np.int64) + np.bitwise_count(s2[x] ^ s2[y])) <= n[x] + n[y],
            lambda: (did[y] <= did[x]) & (c1[x] != c1[y]) & (role[x] & ASKS > 0) & (role[y] & ASKED > 0),
        ):
            ok = np.flatnonzero(test())
            x, y = x[ok], y[ok]
        return x, y

    def both_ways(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """fitting() of unordered pairs: the posting of the later document asks, of one document each may ask the other."""
        later = self.did[i] >= self.did[j]
        x, y = self.fitting(np.where(later, i, j), np.where(later, j, i))
        # the other way is tried on its own: which of the two asks differs between rounds
        same = np.flatnonzero(self.did[i] == self.did[j])
        more = self.fitting(j[same], i[same])
        return np.concatenate([x, more[0]]), np.concatenate([y, more[1]])


def _segments(parts: int) -> Iterator[tuple[np.uint64, np.uint64]]:
    """Masks of the 128 bits of signatures, cut into so many pieces."""
    for i in range(parts):
        lo, hi = 128 * i // parts, 128 * (i + 1) // parts
        bits = (1 << hi) - (1 << lo)
        yield U(bits & (1 << 64) - 1), U(bits >> 64)


def crowded(p: Postings, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the postings ``rows`` of one token: of each asking posting its ``most`` first that fit, by document, and maybe more.

    Signatures of a fitting pair differ in at most (n + m) / 7 bits, so of one piece more than that at least one is equal: only
    postings that share a piece meet.  Sizes of a pair differ by a third at most, so classes of sizes meet themselves and the next one.
    In a piece with very many postings (much alike) each posting meets the earliest ones until it has enough.
    """
    size = np.floor(np.log(p.n[rows]) / np.log(4 / 3) + 1e-9).astype(np.int64)
    xs, ys, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def thinned() -> None:
        nonlocal xs, ys, held
        x, y = np.concatenate(xs), np.concatenate(ys)
        order = np.lexsort((y, p.c1[y], p.did[y], x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        x, y = x[new], y[new]
        keep = np.arange(len(x)) - np.searchsorted(x, x) < most
        xs, ys, held = [x[keep]], [y[keep]], int(keep.sum())

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal held
        xs.append(x)
        ys.append(y)
        held += len(x)
        if held > 2 * PAIRS + most * len(rows):
            thinned()

    for own in np.unique(size):
        r = rows[(size == own) | (size == own + 1)]
        top = int(p.n[rows[size == own]].max())
        apart = (top + min(int(p.n[r].max()), 4 * top // 3)) // 7
        for low, high in _segments(apart + 1):
            piece = mix((p.s1[r] & low) * U(0x9E3779B97F4A7C15) + mix(p.s2[r] & high))
            order = np.lexsort((p.c1[r], p.did[r], piece))
            s, piece = r[order], piece[order]
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            count = np.diff(np.append(first, len(s)))
            end = np.repeat(first + count, count)
            ahead = end - np.arange(len(s)) - 1
            ahead[np.repeat(count, count) > BUCKET] = 0
            total = np.concatenate([[0], np.cumsum(ahead)])
            lo = 0
            while total[lo] < total[-1]:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
                times = ahead[lo:hi]
                i = np.repeat(np.arange(lo, hi), times)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                add(*p.both_ways(s[i], s[j]))
                lo = hi
            for f in np.flatnonzero(count > BUCKET):
                add(*_alike(p, s[first[f] : first[f] + count[f]], most))
    thinned()
    return xs[0], ys[0]


def _alike(p: Postings, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each asking posting of s the ``most`` first of s that fit, at least; s is in order of documents."""
    out_x, out_y = [], []
    asking, found = np.flatnonzero(p.role[s] & ASKS > 0), np.zeros(len(s), np.int64)
    answers = np.flatnonzero(p.role[s] & ASKED > 0)
    did, back = p.did[s], np.argsort(s)
    for lo in range(0, len(answers), BUCKET):
        y = answers[lo : lo + BUCKET]
        # those that have enough, or that come before the rest of the answers, are done
        asking = asking[(found[asking] < most) & (did[asking] >= did[y[0]])]
        if not len(asking):
            break
        for k in range(0, len(asking), PAIRS // BUCKET):
            x = asking[k : k + PAIRS // BUCKET]
            gx, gy = p.fitting(np.repeat(s[x], len(y)), np.tile(s[y], len(x)))
            np.add.at(found, back[np.searchsorted(s[back], gx)], 1)
            out_x.append(gx)
            out_y.append(gy)
    return (np.concatenate(out_x), np.concatenate(out_y)) if out_x else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def met(token: np.ndarray, c1: np.ndarray, did: np.ndarray, n: np.ndarray, at: np.ndarray, s1: np.ndarray, s2: np.ndarray, role: np.ndarray, most: int = 1 << 62) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Postings (x, y) of one token that fit: of each asking x all, or of a token with very many pairs the ``most`` first by document.

    The postings come sorted by token and size n, so those of fitting size are a range.  The shared token at place a of
    n tokens leaves n - a in common at most, and 7 * common >= 3 * (n + m) for similarity 3/4.  From the smaller set
    of a pair on, place and size bound the larger one.
    """
    p = Postings(c1, did, n, at, s1, s2, role)
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(token))))
    width = int(n.max()) + 2
    key = group * width + n
    reach = np.minimum(np.minimum(4 * n // 3, 7 * (n - at) // 3 - n), width - 1)
    hi = np.searchsorted(key, group * width + np.maximum(reach, -1), side="right")
    ahead = np.maximum(hi - np.arange(len(n)) - 1, 0)
    each = np.add.reduceat(ahead, begin)
    bounds, ends = np.append(begin, len(token)), np.cumsum(each)
    full = np.append(np.flatnonzero(each > CROWD), len(begin))
    g = 0
    while g < len(begin):
        after = full[np.searchsorted(full, g)]
        if after == g:
            yield crowded(p, np.arange(bounds[g], bounds[g + 1]), most)
            g += 1
            continue
        # whole tokens, up to the next crowded one
        stop = min(int(after), max(g + 1, int(np.searchsorted(ends, ends[g] - each[g] + PAIRS, side="right"))))
        rows = np.arange(bounds[g], bounds[stop])
        times = ahead[rows]
        i = np.repeat(rows, times)
        yield p.both_ways(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times))
        g = stop


def _candidates(low: int, high: int):
    """Of each asking posting's candidates, earliest documents first, those from low to high, with the bits that their signatures differ in, and a mark (token, y null) where there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now and held:
                    yield from part(held)
                    held = []
                now = row["part"]
                held.append(row)
        if held:
            yield from part(held)

    def part(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate([np.cumsum(from_planes(r["token"], r["n"]), dtype=U) for r in rows])
        block, c1, did, n, at, s1, s2, quiet = (np.concatenate([from_planes(r[k], r["n"]) for r in rows]) for k in ("block", "c1", "did", "size", "at", "s1", "s2", "role"))
        rows.clear()
        n, at, did, role = n.astype(np.int64), at.astype(np.int64), did.view(np.int64), (ASKS | ASKED) - quiet.astype(np.int64)
        order = np.lexsort((block, token)) if block.any() else np.argsort(token)
        # token and block are one key from here on
        key = np.zeros(len(order), np.int64)
        token, block = token[order], block[order]
        key[1:] = np.cumsum((token[1:] != token[:-1]) | (block[1:] != block[:-1]))
        order = order[np.argsort(key << 32 | n[order])]
        c1, did, n, at, s1, s2, role = (v[order] for v in (c1, did, n, at, s1, s2, role))
        for x, y in _nearest(met(key, c1, did, n, at, s1, s2, role, high + 1), did, c1, high):
            # x ascending, its candidates by did
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            nth = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
            mine = (nth >= low) & (nth < high)
            more = nth == high
            names = ["x", "y", "token", "apart"]
            bits = np.bitwise_count(s1[x[mine]] ^ s1[y[mine]]) + np.bitwise_count(s2[x[mine]] ^ s2[y[mine]])
            yield pa.RecordBatch.from_arrays([pa.array(c1[x[mine]].view(np.int64)), pa.array(c1[y[mine]].view(np.int64)), pa.nulls(int(mine.sum()), pa.int64()), pa.array(bits.astype(np.int32))], names)
            yield pa.RecordBatch.from_arrays([pa.array(c1[x[more]].view(np.int64)), pa.nulls(int(more.sum()), pa.int64()), pa.array(token[x[more]].view(np.int64)), pa.nulls(int(more.sum()), pa.int32())], names)

    return run


def _nearest(found: Iterator[tuple[np.ndarray, np.ndarray]], did: np.ndarray, c1: np.ndarray, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs sorted by x and the document of y; of a posting x whose pairs come in several pieces, its first high + 1."""
    x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in found:
        x, y = np.concatenate([x, a]), np.concatenate([y, b])
        order = np.lexsort((c1[y], did[y], x))
        x, y = x[order], y[order]
        if len(x):
            last = int(np.searchsorted(x, x[-1]))
            if last:
                yield x[:last], y[:last]
            x, y = x[last : last + high + 1], y[last : last + high + 1]
    if len(x):
        yield x, y


def _place(did, th, line):
    """A key of a line's place, for filters; of columns or of unsigned numbers."""
    if isinstance(did, np.ndarray):
        return th ^ did << U(40) ^ line
    return th.bitwiseXOR(F.shiftleft(did, 40)).bitwiseXOR(line.cast("long"))


def _line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines that have bytes: row, number within the row, begin and end."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    row = np.searchsorted(off, begin, side="right") - 1
    return row, np.searchsorted(breaks, begin) - np.searchsorted(breaks, off[row]), begin, np.append(begin[1:], len(data))


def _packed_lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of numbers, bounded by at, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


_SETS = "c1 long, c2 long, did long, th long, line int, n int, tokens binary, brief binary"


def _sets(ranks, places: KeyFilter, docs: KeyFilter):
    """Whole sets of the lines whose place the filter lets through, and 16 bits of each token; a token that occurs once is in no intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(docs.test(batch.column(1).to_numpy(zero_copy_only=False))))
            did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, data, off in chunks(batch.column(2), TEXT):
                row, number, begin, end = _line_spans(data, off)
                mine = np.flatnonzero(places.test(_place(did[lo + row].view(U), th[lo + row].view(U), number.astype(U))))
                if not len(mine):
                    continue
                size = (end - begin)[mine]
                own, _, at, token = line_tokens(data[_spread(begin[mine], size)], np.concatenate([[0], np.cumsum(size)]), ranks.value)
                mine = mine[own]
                row, number = lo + row[mine], number[mine]
                c1, c2 = class_hashes(at, token)
                line = np.repeat(np.arange(len(own)), np.diff(at))
                often = token >> U(56) != 0
                brief = np.unique(line[often] << 16 | (token[often] >> U(5) & U(0xFFFF)).astype(np.int64))
                lists = [_packed_lists(np.searchsorted(keys, np.arange(len(own) + 1)), values) for keys, values in ((line[often], token[often]), (brief >> 16, brief.astype(np.uint16)))]
                columns = (c1.view(np.int64), c2.view(np.int64), did[row], th[row], number.astype(np.int32), np.diff(at).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], [x.split(" ")[0] for x in _SETS.split(", ")])

    return run


def removed_lines(ws: Workspace, src: DataFrame) -> DataFrame:
    """(did, th, gone array<int>): numbers of the lines that resemble an earlier one, by document."""
    counts = slot_counts(src.select("text"), SLOTS, _count)
    width = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, -(-int(counts.sum()) // LOAD))
    ranks = ws.spark.sparkContext.broadcast(rarity(counts))
    lines = ws.save(src.select("did", "th", "text").mapInArrow(_lines(ranks, parts), _CLASSES), "lines")
    classes = lines.where("part >= 0").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_classes, _CLASSES)
    classes = ws.save(classes, "classes")
    # where lines are is asked for in the end; what made the classes can go
    places = ws.save(lines.where("part < 0").select("rows", "did", "th", "line", "c1", "c2"), "places")
    ws.drop(lines)
    load = slot_counts(classes.select("prefix", "tokens"), SLOTS, _load)
    parts = max(width, -(-int(load.sum()) // (PART * SHARES)))
    # a slot far above the mean holds a token of very many lines
    blocks = ws.spark.sparkContext.broadcast(np.minimum(1 + np.maximum(0, load - 2 * int(load.mean())) // BLOCK, 65535).astype(np.uint16))
    gone, asking, wanted, low, high, shares = None, None, None, 0, FIRST, SHARES
    while True:
        pairs, made = None, []
        for share in range(shares):
            dealt = classes.select(*_POSTED).mapInArrow(_dealt(parts, share, shares, blocks, asking, wanted), _PACKED)
            found = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_candidates(low, high), "x long, y long, token long, apart int")
            found = ws.save(found.groupBy("x", "y", "token").agg(F.min("apart").alias("apart")), "pairs")
            made.append(found)
            pairs = found if pairs is None else pairs.unionByName(found)
            ws.release()
        # a pair may be there once for each share
        together = pairs.where("y IS NOT NULL")
        count = together.count()
        if count:
            # later rounds list very many pairs of one class
            spread = high // FIRST
            # the nearest signature first, the others only where that one isn't similar after all
            best = ws.save(together.groupBy("x").agg(F.min_by("y", "apart").alias("y")), "best")
            ends = best.select(F.col("x").alias("c1")).unionByName(together.select(F.col("y").alias("c1")))
            sets = _sets_of(ws, src, ranks, classes, KeyFilter(ends, "c1", count))
            found = ws.save(_fitting(best, sets, "tokens", width, spread).select(F.col("x").alias("c1"), "c2").distinct(), "found")
            gone = found if gone is None else gone.unionByName(found)
            rest = together.select("x", "y").join(gone.select(F.col("c1").alias("x")), "x", "left_anti")
            rest = ws.save(rest.distinct() if shares > 1 else rest, "rest")
            ws.drop(best)
            likely = ws.save(_fitting(rest, sets, "brief", width, spread).select("x", "y").distinct(), "likely")
            if not likely.isEmpty():
                gone = gone.unionByName(ws.save(_fitting(likely, sets, "tokens", width, spread).select(F.col("x").alias("c1"), "c2").distinct(), "found"))
            ws.drop(sets, rest, likely)
        rest = pairs.where("y IS NULL").select(F.col("x").alias("c1"), "token")
        rest = ws.save(rest.join(gone, "c1", "left_anti") if gone is not None else rest, "asking")
        ws.drop(*made)
        count = rest.count()
        if not count:
            break
        asking, wanted = KeyFilter(rest, "c1", count), KeyFilter(rest, "token", count)
        ws.drop(rest)
        low, high, shares = high, high * (1 + MORE), 1
    place = F.struct("did", "th", "line")
    removed = KeyFilter(gone, "c1", gone.count()) if gone is not None else None
    known = classes.select(*_BRIEF).mapInArrow(_told(removed, True), _PLACE + ", n long, copies long").select("c1", "c2", place.alias("first"), "copies")
    known = known.join(gone.withColumn("resembles", F.lit(True)), ["c1", "c2"], "left") if gone is not None else known.withColumn("resembles", F.lit(False))
    known = ws.save(known.withColumn("resembles", F.coalesce("resembles", F.lit(False))).where("copies > 1 or resembles"), "known")
    spots = places.mapInArrow(_spots(KeyFilter(known, "c1", known.count())), _PLACE)
    hit = spots.join(known, ["c1", "c2"]).where(F.col("resembles") | (place != F.col("first")))
    out = ws.save(hit.groupBy("did", "th").agg(F.collect_set("line").alias("gone")), "gone")
    ws.drop(places, classes, known)
    return out


#: Places up to which the rows of their texts are picked by a broadcast join, before they go to Python.
FEW = 1 << 14


def _sets_of(ws: Workspace, src: DataFrame, ranks, classes: DataFrame, inside: KeyFilter) -> DataFrame:
    """Whole sets, as in _SETS, of the classes that the filter lets through, read from the texts again at the classes' first places.

    There may be more: sets of other classes, and of a class's later lines.
    """
    told = classes.select(*_BRIEF).mapInArrow(_told(inside, False), _PLACE + ", n long, copies long")
    involved = ws.save(told.select("did", "th", _place(F.col("did"), F.col("th"), F.col("line")).alias("place")), "involved")
    count = involved.count()
    texts = src.select("did", "th", "text")
    if count <= FEW:
        texts = texts.join(F.broadcast(involved.select("did", "th").distinct()), ["did", "th"], "left_semi")
    read = texts.mapInArrow(_sets(ranks, KeyFilter(involved, "place", count), KeyFilter(involved, "th", count)), _SETS)
    sets = ws.save(read, "sets")
    ws.drop(involved)
    return sets


#: Marks of values that a task holds at once.
MARKS = 1 << 22
_SENT = ("c1", "c2", "did", "th", "line", "n")


def _compared(name: str):
    """(x, y, c2) of the pairs, with what is sent of their classes, that are similar by their tokens or may be by 16 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            for lo, hi in zip(bounds, [*bounds[1:], len(part)]):
                if part[lo] != now and held:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                now = part[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compare(pa.Table.from_batches(held))

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pair = rows.column("y").is_valid()
        x, y = (rows.filter(pair).column(k).to_numpy() for k in ("c1", "y"))
        sets = rows.filter(rows.column("y").is_null())
        c1, c2, did, th, line, n = (sets.column(k).to_numpy() for k in _SENT)
        # the first place of each class
        order = np.lexsort((line, th, did, c2, c1))
        new = np.ones(len(order), bool)
        new[1:] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])
        order = order[new]
        c1, c2, did, th, line, n = (v[order].astype(np.int64) for v in (c1, c2, did, th, line, n))
        lists = sets.column(name).take(pa.array(order)).to_pylist()
        kind = np.dtype("<u8" if name == "tokens" else "<u2")
        size = np.array([len(v) // kind.itemsize for v in lists], np.int64)
        value = np.frombuffer(b"".join(lists), kind)
        if name == "tokens":
            value = np.unique(value, return_inverse=True)[1]
        value = value.astype(np.int64)
        span = int(value.max()) + 1 if len(value) else 1
        begin = np.cumsum(size) - size
        i, j = _each(c1, x, y)
        earlier = (did[j] < did[i]) | (did[j] == did[i]) & ((th[j] < th[i]) | (th[j] == th[i]) & (line[j] < line[i]))
        order = np.flatnonzero(earlier)
        order = order[np.argsort(i[order], kind="stable")]
        i, j = i[order], j[order]
        # a few lines' sets at a time are marked in a table, where the other sides' values look
        nth = np.cumsum(np.concatenate([[0], i[1:] != i[:-1]])) if len(i) else i
        room = max(1, MARKS // span)
        marks, ends, lo = np.zeros(room * span, bool), np.cumsum(size[j]), 0
        while lo < len(i):
            hi = min(int(np.searchsorted(ends, ends[lo] - size[j[lo]] + PAIRS, side="right")), int(np.searchsorted(nth, nth[lo] + room)))
            hi = max(lo + 1, hi)
            a, b, at = i[lo:hi], j[lo:hi], (nth[lo:hi] - nth[lo]) * span
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            mine = np.repeat(at[first], size[a[first]]) + value[_spread(begin[a[first]], size[a[first]])]
            marks[mine] = True
            hits = np.concatenate([[0], np.cumsum(marks[np.repeat(at, size[b]) + value[_spread(begin[b], size[b])]])])
            marks[mine] = False
            upto = np.cumsum(size[b])
            common = hits[upto] - hits[upto - size[b]]
            if name == "brief":  # tokens of equal values are one: shared ones are as many fewer as the line has fewer values
                common = common + n[a] - size[a]
            ok = common * 7 >= (n[a] + n[b]) * 3
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c1[a[ok]], c1[b[ok]], c2[a[ok]])], ["x", "y", "c2"])
            lo = hi

    return run


def _each(keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) in the sorted keys of all pairs of a key equal to x and one equal to y."""
    lo, times = np.searchsorted(keys, x), np.searchsorted(keys, x, side="right") - np.searchsorted(keys, x)
    i, j = _spread(lo, times), np.repeat(y, times)
    lo, times = np.searchsorted(keys, j), np.searchsorted(keys, j, side="right") - np.searchsorted(keys, j)
    return np.repeat(i, times), _spread(lo, times)


#: Pairs of a part that are compared at once, at least (where there are few) and at most on average.
LEAST, COMPARED = 1 << 8, 1 << 15


def _fitting(pairs: DataFrame, sets: DataFrame, name: str, width: int, spread: int) -> DataFrame:
    """(x, y, c2) of the pairs (x, y) in a table that are similar by their tokens, or may be by their brief.

    Pairs are dealt by x (and to ``spread`` parts of each x), and each class's set goes once to every part that has a
    pair with it: a class that very many others are like is compared by all parts.
    """
    count = pairs.count()
    parts = max(min(width, 1 + count // LEAST), count // COMPARED)
    part = F.pmod(F.xxhash64("x", F.pmod("y", F.lit(spread))), F.lit(parts)).cast("int").alias("part")
    wants = pairs.select(part, F.col("x").alias("c1")).unionByName(pairs.select(part, F.col("y").alias("c1"))).distinct()
    sent = wants.join(sets.select(*_SENT, name), "c1").select("part", *_SENT, F.lit(None).cast("long").alias("y"), name)
    links = pairs.select(part, F.col("x").alias("c1"), *[F.lit(None).cast(sets.schema[k].dataType).alias(k) for k in _SENT[1:]], "y", F.lit(None).cast("binary").alias(name))
    return sent.unionByName(links).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_compared(name), "x long, y long, c2 long")


def _finish(shared: KeyFilter | None, keep: bool):
    """The rows whose text the filter rules out, done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                batch = batch.filter(pa.array(~shared.test(batch.column(1).to_numpy(zero_copy_only=False))))
            yield from _drop(keep, False)([batch])

    return run


def _open(shared: KeyFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.test(batch.column(1).to_numpy(zero_copy_only=False))))

    return run


def _drop(keep: bool, cut: bool = True):
    """(did, n_lines, n_removed, kept_sha256, text, rest) of rows (did, th, text, rest[, gone]); without keep, the text is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, shas, texts = [], [], [], []
            marks = batch.column("gone").to_pylist() if cut else [None] * len(batch)
            for text, gone in zip(batch.column("text").to_pylist(), marks):
                n.append(text.count("\n") + 1 if text else 0)
                out = set(gone or ())
                if out:
                    text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in out])
                removed.append(len(out))
                shas.append(hashlib.sha256(text.encode()).hexdigest())
                texts.append(text if keep else None)
            arrays = [batch.column("did"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), batch.column("rest")]
            yield pa.RecordBatch.from_arrays(arrays, ["did", "n_lines", "n_removed", "kept_sha256", "text", "rest"])

    return run


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each line whose set of words (A-Z lower-cased) has a Jaccard similarity of 0.75 or more to an earlier line's.

    Lines end at \\n; earlier means a smaller doc_id or, within a document, above.  Lines are judged on the input: a
    line that is removed itself still counts as an earlier one.  Returns (doc_id, n_lines, n_removed, kept_sha256), a row per
    row; with ``with_text`` also the text that is left and ``rest``, a struct of the other columns.

    Lines of one set are one class.  Postings of the classes' prefixes are shuffled by token, packed; a signature of 128 bits
    bounds the tokens in which two sets differ and leaves few pairs to verify.  Of a class's candidates
    16 bits a token leave the likely ones, of which whole sets verify the best one first; classes that no candidate
    removes ask for more, in rounds that grow until none has any left, so a group of many near copies costs about one comparison each and no pair is left out.

    Lines without words resemble nothing and stay.  Null or empty text has no lines.  Null ids come first; rows that
    repeat an id and a text are at one place and keep or lose their lines together.
    """
    ws = Workspace(docs.sparkSession, "lines")
    src = keyed(docs, id_col, text_col, keep=True)
    if not with_text:
        src = src.withColumn("rest", F.lit(None).cast("int"))
    gone = removed_lines(ws, src)
    n = gone.count()
    ws.release()
    kind = f"text string, rest {src.schema['rest'].dataType.simpleString()}"
    final = f"did long, n_lines long, n_removed long, kept_sha256 string, {kind}"
    thin = KeyFilter(gone, "th", n) if n else None
    done = src.mapInArrow(_finish(thin, with_text), final)
    if n:
        some = src.mapInArrow(_open(thin), f"did long, th long, {kind}").join(gone, ["did", "th"], "left").select("did", "text", "rest", "gone")
        done = done.unionByName(some.mapInArrow(_drop(with_text), final))
    return done.select(real_id().alias("doc_id"), *[c for c in done.columns if c != "did" and (with_text or c not in ("text", "rest"))])
