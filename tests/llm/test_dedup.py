import random
from collections import Counter

import numpy as np
import pytest

from corpus import SCHEMA, components, corpus, repeated_words, sha, shingle_set, similar_lines, words
from nubila.llm import line_dedup as line_dedup_module
from nubila.llm import near_dedup
from nubila.llm.line_dedup import line_dedup
from nubila.llm.near_dedup import near_duplicates
from nubila.llm.substring_dedup import substring_dedup


def lined(rows):
    """Break texts into lines so that lines repeat and resemble each other."""
    out = []
    for r in rows:
        w = (r[1] or "").split(" ")
        out.append((r[0], "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)) if r[1] else r[1], *r[2:]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup(spark, small, monkeypatch):
    if small:  # tokens in several blocks, pieces of few pairs, and rounds that don't find all at once
        for name, value in {"BLOCK": 7, "PAIRS": 5, "FIRST": 1, "MORE": 1, "PART": 50, "HELD": 5}.items():
            monkeypatch.setattr(line_dedup_module, name, value)
    rows = lined(corpus())
    plain = list({r[0]: r for r in rows if r[0] is not None}.values())
    want = similar_lines([(r[0], r[1]) for r in plain])
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(plain, SCHEMA), with_text=True).collect()}
    assert {i: r.text for i, r in out.items()} == want
    for r in plain:
        assert out[r[0]].kept_sha256 == sha(want[r[0]]) and out[r[0]].n_lines - out[r[0]].n_removed == (want[r[0]].count("\n") + 1 if want[r[0]] or out[r[0]].n_lines > out[r[0]].n_removed else 0)
        assert out[r[0]].rest.kept == r[5]
    assert len(line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == len(rows)
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("small", [32, 1])
def test_near_duplicates(spark, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 3 if small == 1 else 256)
    rows = corpus()
    nobody = 10**9
    ids = [(r[0] if r[0] is not None else nobody + k, r[1]) for k, r in enumerate(rows)]
    want = components(ids)
    got = Counter(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    id_or_none = lambda i: i if i < nobody else None
    assert got == Counter((id_or_none(i), len(shingle_set(t)), id_or_none(want[i]), i == want[i]) for i, t in ids)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_substring_dedup(spark):
    rows = corpus()
    want = Counter()
    texts = Counter()
    for r, (w, gone) in zip(rows, repeated_words([r[1] for r in rows])):
        want[r[0], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))] += 1
        texts[r[0], " ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert sum(k[2] for k in want)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    assert Counter((r.doc_id, " ".join(words(r.text))) for r in got) == texts
    assert Counter(tuple(r) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == want
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_of_copies_without_an_id(spark):
    own = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(None, own(1))] * 5 + [(None, own(2)), (None, own(3)), (None, own(3)), (4, own(3)), (7, own(5)), (7, own(5)), (7, own(6)), (None, ""), (None, ""), (None, None), (None, None), (8, " "), (8, " ")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    kept = Counter((r.doc_id, r.n_shingles > 0, r.component_id) for r in near_duplicates(docs).collect() if r.kept)
    assert kept == {(None, True, None): 2, (4, True, 4): 1, (7, True, 7): 3, (None, False, None): 4, (8, False, 8): 2}
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == {(None, own(1)): 1, (None, own(2)): 1, (4, own(3)): 1, (7, own(5)): 1, (7, own(6)): 1, (None, ""): 2, (None, None): 2, (8, " "): 2}
    assert all(rows[r.k] == (r.doc_id, r.text) for r in got)


def test_texts_without_an_id_that_share_32_bits_of_hash_stay_apart(spark):
    rows = [(None, "text number 149234"), (None, "text number 262723"), (5, "text number 149234")]
    docs = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node int, __node int")
    found = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert found == {(None, 5, False): 1, (None, None, True): 1, (5, 5, True): 1}
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.node for r in out.collect()) == [1, 2]


def test_line_dedup_of_repeated_and_missing_ids(spark):
    rows = [(None, "a b c d\nx y z"), (3, "d c b a\nown line"), (3, "d c b a\nown line"), (3, "other\na b c d"), (4, None), (5, "")]
    got = Counter((r.doc_id, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect())
    # rows of one id and text are at one place and keep their lines
    assert got == {(None, "a b c d\nx y z"): 1, (3, "own line"): 2, (3, "other"): 1, (4, ""): 1, (5, ""): 1}


@pytest.mark.parametrize("part", [4, 1 << 19])
def test_classes_of_lines_from_many_tasks(part, monkeypatch):
    monkeypatch.setattr(line_dedup_module, "PART", part)
    monkeypatch.setattr(line_dedup_module, "PACKED", 3)
    rng, want, rows = random.Random(3), {}, []
    for k in range(30):
        lines = []
        for _ in range(rng.randint(1, 6)):
            c = rng.choice([-7, 1, 2, 3, 4, 5, 6, 7, 8, 9])
            place, copies = (rng.randint(-3, 3), rng.randint(-9, 9), rng.randint(0, 4)), rng.randint(1, 3)
            lines.append((*place, copies, c, c % 2, 9, 1, 2, 0, abs(c) % 3))
            first, n = want.get((c, c % 2), (place, 0))
            want[c, c % 2] = min(first, place), n + copies
        t = dict(zip(line_dedup_module._FIELDS, np.array(lines, np.int64).T.copy()))
        t["tokens"] = np.concatenate([np.arange(x[-1], dtype=np.uint64) + np.uint64(x[4] + 10) for x in lines])
        rows.append(line_dedup_module._pack(t, k // 30))
    got = {}
    for batch in line_dedup_module._classes([line_dedup_module._arrow(rows[:11]), line_dedup_module._arrow(rows[11:])]):
        for row in batch.to_pylist():
            t = line_dedup_module._unpack(row)
            assert row["rows"] <= 3
            ends = np.cumsum(t["size"])
            for i, c in enumerate(t["c1"].tolist()):
                assert (c, int(t["c2"][i])) not in got
                got[c, int(t["c2"][i])] = (int(t["did"][i]), int(t["th"][i]), int(t["line"][i])), int(t["copies"][i])
                assert t["tokens"][ends[i] - t["size"][i] : ends[i]].tolist() == list(range(c + 10, c + 10 + abs(c) % 3))
    assert got == want


def test_many_copies_of_one_row_give_their_spans_once(spark):
    """Rows that share a null id and a text: all of their words go, and their spans are one short list."""
    from nubila.llm import substring_dedup
    from nubila.llm.rows import keyed
    from nubila.llm.workspace import Workspace

    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", f"'{text}' as text")
    spans = substring_dedup.repeated_spans(Workspace(spark, "copies"), keyed(docs, "doc_id", "text"), substring_dedup.WIDTH, substring_dedup.ANCHOR).collect()
    assert len(spans) == 1 and len(spans[0].spans) < 400
    out = substring_dedup.substring_dedup(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert [tuple(r) for r in out] == [(None, 400, 400, 3000)]


def _postings(rng, lines):
    """Columns of postings of one token for sets of tokens, by size, as line_dedup packs them."""
    from nubila.llm.textcore import mix

    lines.sort(key=lambda r: len(r[1]))
    sig = []
    for _, tokens in lines:
        bits = 0
        for t in tokens:
            bits ^= 1 << (int(mix(np.array([t + 1], np.uint64))[0]) & 127)
        sig.append((bits & (1 << 64) - 1, bits >> 64))
    u = lambda v: np.array(v, np.uint64)
    n = np.array([len(t) for _, t in lines], np.int64)
    return u(range(10, 10 + len(lines))), np.array([d for d, _ in lines]), n, np.zeros(len(lines), np.int64), u([a for a, _ in sig]), u([b for _, b in sig]), np.array([rng.choice([1, 2, 3, 3]) for _ in lines])


def test_postings_of_one_crowded_token(monkeypatch):
    """Buckets of signatures find each posting's first partners, as all pairs do."""
    from nubila.llm import line_dedup as L

    rng = random.Random(3)
    lines, base = [], [rng.sample(range(60), 14) for _ in range(3)]
    for i in range(500):
        kind = rng.random()
        tokens = set(rng.choice(base)) if kind < 0.5 else set(rng.sample(range(60), rng.randint(1, 20)))
        if kind < 0.4:
            tokens = tokens - {rng.choice(sorted(tokens))} | {rng.randrange(60)}
        lines.append((rng.randint(0, 200), tokens))
    c1, did, n, at, s1, s2, role = _postings(rng, lines)
    token = np.zeros(len(n), np.int64)
    want = {}
    for x in range(len(n)):
        fits = [y for y in range(len(n)) if role[x] & 1 and role[y] & 2 and y != x and did[y] <= did[x] and 7 * min(n[x], n[y]) >= 3 * (n[x] + n[y]) and 7 * (int(s1[x] ^ s1[y]).bit_count() + int(s2[x] ^ s2[y]).bit_count()) <= n[x] + n[y]]
        want[x] = [(did[y], c1[y]) for y in sorted(fits, key=lambda y: (did[y], c1[y]))]
    for crowd, bucket, most in ((1 << 40, 64, 1 << 40), (0, 64, 5), (0, 8, 5), (0, 4, 17), (0, 100, 1 << 40)):
        monkeypatch.setattr(L, "CROWD", crowd)
        monkeypatch.setattr(L, "BUCKET", bucket)
        got = {x: [] for x in want}
        for xs, ys in L._nearest(L.met(token, c1, did, n, at, s1, s2, role, most), did, c1, most - 1):
            for x, y in zip(xs.tolist(), ys.tolist()):
                got[x].append((did[y], c1[y]))
        assert all(got[x][:most] == want[x][:most] for x in want), (crowd, bucket, most)


def test_a_crowded_token_takes_no_quadratic_time():
    import time

    from nubila.llm import line_dedup as L

    rng = np.random.default_rng(1)
    m = 200_000
    n = np.sort(rng.integers(4, 14, m))
    u = lambda: rng.integers(0, 1 << 63, m).astype(np.uint64)
    family = rng.random(m) < 0.3
    s1, s2 = u(), u()
    s1[family], s2[family] = 7, 9
    began = time.perf_counter()
    found = sum(len(x) for x, _ in L._nearest(L.met(np.zeros(m, np.int64), u(), rng.integers(0, 50_000, m), n, np.zeros(m, np.int64), s1, s2, np.full(m, 3), 17), rng.integers(0, 50_000, m), u(), 16))
    assert found > 100_000 and time.perf_counter() - began < 60


def test_sets_are_read_of_the_chosen_lines_alone(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from nubila.llm import line_dedup as L

    texts = ["a b c\nB  a\n\n", "", None, "one two\nthree four five six\nseven", "x\ty z"]
    did, th = np.arange(5) - 2, np.array([5, 6, 7, 1 << 62, -9]) * 3
    chosen = {(0, 1), (3, 1), (4, 0)}
    keys = {int(L._place(did[r : r + 1].view(np.uint64), th[r : r + 1].view(np.uint64), np.array([k], np.uint64))[0]) for r, k in chosen}
    places = type("", (), {"test": lambda self, key: np.array([int(k) in keys for k in key], bool)})()
    docs = type("", (), {"test": lambda self, key: key != th[0] + 1})()
    seen, whole = [], L.line_tokens
    monkeypatch.setattr(L, "line_tokens", lambda data, *a: seen.append(bytes(data)) or whole(data, *a))
    ranks = type("", (), {"value": np.ones(L.SLOTS, np.uint8)})()
    got = [r for b in L._sets(ranks, places, docs)([pa.RecordBatch.from_arrays([pa.array(did), pa.array(th), pa.array(texts)], ["did", "th", "text"])]) for r in b.to_pylist()]
    assert b"".join(seen) == b"B  a\nthree four five six\nx\ty z"
    assert [(r["did"] + 2, r["line"], r["n"], len(r["tokens"]) // 8, len(r["brief"]) // 2) for r in got] == [(0, 1, 2, 2, 2), (3, 1, 4, 4, 4), (4, 0, 3, 3, 3)]


def test_pairs_of_one_line_with_many_are_compared_by_many_parts(spark, monkeypatch):
    import numpy as np
    from nubila.llm import line_dedup as L

    monkeypatch.setattr(L, "LEAST", 16)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(40, rng.integers(20, 41), replace=False).astype(np.uint64)) for _ in range(400)]
    rows = [(k, k + 1, k, 0, 0, len(v), v.tobytes(), v.astype(np.uint16).tobytes()) for k, v in enumerate(sets)]
    rows += [(0, 1, 500, 0, 0, 1, b"", b"")]  # a later line of a class is not its first place
    pairs = [(x, 0) for x in range(1, 400)]
    want = {(x, y, x + 1) for x, y in pairs if 7 * len(np.intersect1d(sets[x], sets[y])) >= 3 * (len(sets[x]) + len(sets[y]))}
    assert 0 < len(want) < len(pairs)
    for name in ("tokens", "brief"):
        got = L._fitting(spark.createDataFrame(pairs, "x long, y long"), spark.createDataFrame(rows, L._SETS), name, 4, 1)
        assert {tuple(r) for r in got.collect()} == want
        made = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(n > 0 for n in made) > 1
