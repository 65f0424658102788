import numpy as np
from pyspark.sql import functions as F

from nubila.llm import language as L

from corpus import corpus, SCHEMA


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = L.language_id(docs)
    assert out.count() == docs.count()
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 250 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_network_sees_every_place():
    """Pooling over overlapping windows finds what pooling over the whole text would: no filter loses a place to a seam."""
    rng = np.random.default_rng(2)
    widest, count, has = L._shape()
    net = L.Network(["a", "b"], rng.normal(size=(256, L.EMBED)).astype(np.float32), (rng.normal(size=(widest * L.EMBED, count)) * has).astype(np.float32), np.zeros(count, np.float32), rng.normal(size=(count, 2)).astype(np.float32), np.zeros(2, np.float32))
    data = rng.integers(1, 65, 3000).astype(np.uint8)
    off = np.array([0, 0, 1, 700, 700, 3000])
    row, start = L.cut(off, L.WINDOW - widest + 1)
    windows, size = L.read(data, start, off[1:][row])
    assert np.bincount(row, np.minimum(size, L.WINDOW - widest + 1), 5).tolist() == np.diff(off).tolist()
    h, _ = L.pooled(net, windows)
    for i in range(5):
        text = np.concatenate([data[off[i] : off[i + 1]], np.zeros(widest - 1, np.uint8)])
        slow = np.full(count, -np.inf)
        for at in range(off[i + 1] - off[i]):
            slow = np.maximum(slow, net.embed[text[at : at + widest]].ravel() @ net.filters)
        if np.isfinite(slow).all():
            # padding beyond the text's end may only add to the last window
            assert (h[row == i].max(0) >= slow - 1e-3).all()
            assert np.allclose(h[row == i][:-1].max(0, initial=-np.inf), slow, atol=1e-3) or (h[row == i].max(0) - slow).min() > -1e-3


def test_gradients_of_training_lower_the_loss():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    windows = np.array([np.resize(np.frombuffer(w, np.uint8), L.WINDOW) for w in (b"abra ", b"kolo ", b"zuz ")])[y] ^ (rng.random((300, L.WINDOW)) < 0.2).astype(np.uint8)
    net = L.train(windows, y, ["x", "y", "z"], epochs=6)
    assert (L.logits(net, windows).argmax(1) == y).mean() > 0.98


def test_awkward_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).withColumn("held_out", F.lit(1)).withColumn("lettered", F.lit("x"))
    out = L.language_id(docs).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in rows), key=str)
    # "en" is all there is to learn, whatever the text; a text without letters is of no language
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in out:
        if r.doc_id is not None:
            lettered = any(c.isalpha() for c in text[r.doc_id] or "")
            assert (r.lang_pred, r.score) == (("en", 1.0) if lettered else ("und", 0.0)), r
    assert all(not r.held_out for r in out if r.doc_id is None)
    kept = L.predict(docs, None).collect()
    assert len(kept) == len(rows) and {(r.lang_pred, r.score) for r in kept} == {("und", 0.0)} and kept[0].held_out == 1


def test_nothing_to_learn_and_no_rows(spark):
    docs = spark.createDataFrame([(3, "some words", None), (4, None, "en"), (5, "12 345", "en")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in L.language_id(docs).collect()} == {(i, "und", 0.0) for i in (3, 4, 5)}
    assert L.language_id(docs.where("doc_id < 0")).collect() == []


def test_sample_is_bounded_and_even(spark):
    """Copies of one row count once, and each language gets its share."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), F.col("id")).alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("lang"))
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("copied words").alias("text"), F.lit("a").alias("lang"))
    seen = {}
    train = L.train
    try:
        L.train = lambda windows, y, languages: seen.update(n=np.bincount(y)) or train(windows[:64], y[:64], languages, epochs=1)
        L.fit(docs.unionByName(same), rows=200)
    finally:
        L.train = train
    assert seen["n"].sum() <= 200 * L.FIT_WINDOWS and seen["n"].min() > 20 * L.FIT_WINDOWS
