import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nubila.llm import alignment as A

from corpus import SCHEMA, corpus

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def alphabet():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(256 + n)] = b
            n += 1
    return out


def brute_force(rows):
    """Token by token, from the libraries' own ids of whole texts."""
    a, b = libraries()
    back = alphabet()
    docs = []
    for key, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        whole = (" " + text).encode() if text else b""
        if b"".join(ta) != whole or b"".join(tb) != whole:
            ia = ib = ta = tb = []
        spans = []
        for tokens in (ta, tb):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for cut in shared:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, sp) if before <= s and e <= cut) for ids, sp in ((ia, spans[0]), (ib, spans[1]))))
            before = cut
        links, j0 = [], 0
        for i, (s, e) in zip(ia, spans[0]):
            while j0 < len(ib) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(ib) and spans[1][j][0] < e:
                links.append((i, ib[j]))
                j += 1
        docs.append((key, len(ia), len(ib), groups, links))
    count = Counter(p for d in docs for p in set(d[4]))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return sorted(((k, n_a, n_b, len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, n_a, n_b, g, links in docs), key=str)


HARD = ["<s> and </s> <unk> <0x41> <|endoftext|>", "a ▁ b", "▁", " ", "  ", "\n", " \n x  y   z\t\tq ", "x" * 700 + " " * 900 + "y \x1c z", "naïve 😀👍🏽 ﬁ ½ é ​　漢字 かな", "don't we'll  'tis", "\x00 a\x00b", "a b  c", "1234567 3.14", "word " * 500, "  x \x85 y", "<|endoftext|>"]


@pytest.mark.parametrize("chunk", [1 << 20, 3000])
def test_alignment_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK", chunk)
    monkeypatch.setattr(A, "BLOCK", chunk * 8)
    rows = corpus() + [(7000 + i, t, None, None, None, None, None) for i, t in enumerate(HARD)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("pairs", F.lit("p")).withColumn("block", F.lit(1)).withColumn("did", F.lit(9))
    out = A.align(docs.repartition(3), *PATHS)
    assert sorted(map(tuple, out.collect()), key=str) == brute_force([(r[0], r[1]) for r in rows])


def test_groups_are_kept(spark):
    docs = spark.createDataFrame([(1, "the naïve café"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in A.align(docs, *PATHS, with_groups=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256 and len(rows[1].groups.split(";")) == rows[1].n_groups
    a, b = libraries()
    sides = [g.split("|") for g in rows[1].groups.split(";")]
    assert [int(i) for g in sides for i in g[0].split(",")] == a.encode(" the naïve café").ids
    assert [int(i) for g in sides for i in g[1].split(",")] == b.encode("the naïve café")
    assert rows[2].groups == rows[2].groups_sha256 == ""


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(docs, *PATHS).collect() == []


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(size) < 0.3)
        bits = A.Bits(places, size)
        at = np.arange(size + 1)
        assert bits.rank(at).tolist() == np.searchsorted(places, at).tolist()
        assert A.select(bits.words).tolist() == places.tolist()
