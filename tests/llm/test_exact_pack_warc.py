import zlib
from collections import Counter, defaultdict
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpus import SCHEMA, corpus, sha
from nubila.llm import exact_dedup, packing, warc


@pytest.mark.parametrize("capacity", [50_000, 3])
def test_exact_dedup(spark, capacity):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    low = lambda ids: None if None in ids else min(ids)
    want = Counter((r[0], low(g), len(g), r[0] == low(g), sha(norm(r[1]))) for r in rows for g in [groups[norm(r[1])]])
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), capacity=capacity).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_directory_doubles_only_for_overfull_buckets(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) as hkey").union(spark.range(3000).selectExpr("xxhash64(id) & (-1L >>> 3) as hkey"))
    entries = exact_dedup.directory(keys, 400, 16)
    depth = len(entries).bit_length() - 1
    assert [e[0] for e in entries] == list(range(1 << depth))
    shared = Counter(e[1] for e in entries)
    assert all(shared[b] == 1 << (depth - local) for _, b, local in entries) and len(set(shared.values())) > 1


def test_pack(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, rows = Tokenizer.from_file(path), corpus()
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), path, limit=64, with_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 and r.length == 1 << r.bucket and r.ids_crc32 == zlib.crc32(r.ids)
        by[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    assert len({r.sequence_id for r in got}) == len(got)
    want = Counter()
    for r in rows:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[r[0], len(ids)] += 1
        pieces = sorted(p for p in by[r[0], len(ids)])
        if want[r[0], len(ids)] == 1 and [x[0] for x in rows].count(r[0]) == 1:
            assert b"".join(p for _, p in pieces) == np.array(ids, "<u4").tobytes()
    assert sum(len(x[1]) for v in by.values() for x in v) == 4 * sum(n * c for (_, n), c in want.items())
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).collect() == []


def test_warc_round_trip(spark):
    long = "x" * 90 + "\r\n\r\nWARC/1.1\r\n" + "é" * 20
    rows = [(5, "http://a/ b\r\nX: y", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (7, "v", "y" * 100), (7, "v", "y" * 100), (8, "w", "y" * 99), (10, "w", "y" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.revisit_table(pages).collect())
    origin = {long: 3, "y" * 100: 7}
    want = Counter()
    for i, _, html in rows:
        html = html or ""
        o = origin.get(html)
        again = i is not None and o is not None and o != i
        want[i, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", o if again else None] += 1
    assert got == want
    assert warc.revisit_table(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pack_long_runs_as_the_library_does():
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode.fast is not None
    for text in ("a" + " " * 1_000_000 + "b", " " * 4999 + "x", "x" + "\n \t" * 3000, "abcdefghij" * 100_000):
        assert encode(text) == np.array(encode.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_archives_have_a_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " + "payload " * (i % 50) + "é\r\n\r\n") for i in range(300)] + [(300, "big", "x" * 3_000_000)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/a")
    assert len(list((tmp_path / "a").glob("part-*"))) > 3
    got = {r.page_id: r.payload for r in warc.read_archives(spark, f"{tmp_path}/a", with_payload=True).collect()}
    assert {i: h.encode() for i, _, h in pages.collect()} == {i: bytes(p) for i, p in got.items()}


def test_runs_of_white_space_take_no_quadratic_time():
    import time

    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = (" " * 4999 + "x") * 200
    began = time.perf_counter()
    want = encode.model.encode(text, add_special_tokens=False).ids
    library = time.perf_counter() - began
    began = time.perf_counter()
    got = encode(text)
    assert time.perf_counter() - began < 5 * library + 2
    assert np.frombuffer(got, "<u4").tolist() == want
    # just below the switch to the library
    text = (" " * 199 + "x") * 500
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.model.encode(text, add_special_tokens=False).ids
