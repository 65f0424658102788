import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpus import SCHEMA, corpus
from nubila.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(model, text):
    e = model.encode(text or "", add_special_tokens=False)
    return len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode(spark):
    rows, model = corpus(), Tokenizer.from_file(PATH)
    got = Counter(tuple(r) for r in bpe.encode_decode(spark.createDataFrame(rows, SCHEMA), PATH).collect())
    assert got == Counter((r[0], *expected(model, r[1])) for r in rows)
    assert bpe.encode_decode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_words_of_the_shared_documents(spark):
    rows, model = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect(), Tokenizer.from_file(PATH)
    odd = ["aaaa aaa aa", "don't we'll", "\x1c\x1d x\u0085y ​ z", "ΑΣ Σ ΑΣΑ", "İstanbul ǅ", "é Å", "日本語 テスト 123 ４５", "😀😀 ok", "﻿x", "<|endoftext|><|endoftext|>x", "a<|startoftext|>", "  x", "!!!???...", "hello" * 50]
    texts = [r[0] for r in rows] + odd
    got = bpe.TrieEncoder(PATH).encode_batch(texts)
    for t, (ids, text, n) in zip(texts, got):
        assert (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) == expected(model, t), t[:80]


def test_every_token_of_the_vocabulary():
    encoder = bpe.TrieEncoder(PATH)
    back = {c: b for b, c in bpe.byte_alphabet().items()}
    words = []
    for t in encoder.ids:
        try:
            words.append(bytes(back[c] for c in t.removesuffix("</w>")).decode())
        except (UnicodeDecodeError, KeyError):
            pass
    words = [w for w in dict.fromkeys(words) if w and encoder.words(w) == [w]]
    encoder.learn(words)
    want = encoder.library.encode_batch(words, add_special_tokens=False)
    assert len(words) > 30_000
    for w, e in zip(words, want):
        assert encoder.known[w][0] == np.array(e.ids, "<u4").tobytes(), w


def test_decode_takes_stored_ids(spark):
    rows, model = corpus(), Tokenizer.from_file(PATH)
    full = bpe.encode_decode(spark.createDataFrame(rows, SCHEMA), PATH, full=True).drop("decoded")
    got = bpe.decode(full, PATH).collect()
    want = Counter((r[0], model.decode(model.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in rows)
    assert Counter((r.doc_id, r.decoded) for r in got) == want
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)
    last = model.get_vocab_size() - 1
    some = [[], [last, 0, 17, last], list(range(0, last, 97)), [10**6, 5]]
    stored = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(some)] + [(9, None)], "k int, ids binary")
    assert {r.k: r.decoded for r in bpe.decode(stored, PATH).collect()} == {9: None, **{k: model.decode(x, skip_special_tokens=False) for k, x in enumerate(some)}}


def test_long_words_as_the_library_does():
    w = bpe.TrieEncoder(PATH)
    for n in (999, 1000, 300_000):
        text = "x " + "abcdefghij"[: n % 7 + 3] * (n // 3) + " é"
        ids = w.library.encode(text, add_special_tokens=False).ids
        assert w.encode_batch([text])[0][::2] == (b"".join(i.to_bytes(4, "little") for i in ids), len(ids))


def test_every_code_point_encodes_as_the_library_does():
    """All code points of the planes in use and one in 16 of the others, between letters, between digits and alone."""
    import numpy as np

    from nubila.llm.bpe import TrieEncoder

    encoder = TrieEncoder(public_tokenizers.path("word_bpe_49k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33000 or c >> 16 == 14 or c % 16 == 5)]
    texts = ["".join(f"a{c}b 1{c}2 {c} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for lo in range(0, len(texts), 512):
        part = texts[lo : lo + 512]
        want = encoder.library.encode_batch(part, add_special_tokens=False)
        for text, (ids, decoded, n), w in zip(part, encoder.encode_batch(part), want):
            assert np.frombuffer(ids, "<u4").tolist() == w.ids and n == len(w.ids), hex(ord(text[1]))
            assert decoded == encoder.library.decode(w.ids, skip_special_tokens=False)
