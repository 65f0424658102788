from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpus import components, corpus, repeated_words, similar_lines
from nubila.llm import packing, toxicity
from nubila.llm.toxicity import held_out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = list({r[0]: (r[0], r[1], r[2], r[3], r[4]) for r in corpus() if r[0] is not None}.values())
    rows = [(i, t and t.replace(" b ", "\n") + " nastyword" * (i % 5 == 0), *rest) for i, t, *rest in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int("nastyword" in (r[1] or ""))) for r in rows], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out()))
    matcher = toxicity.Matcher(model.lexicon)

    def rejected(text):
        x = model.weights[0] + toxicity.features(matcher, text or "") @ model.weights[1:]
        return 1 / (1 + np.exp(-x)) >= toxicity.THRESHOLD

    left = {r[0]: r[1] for r in rows if not rejected(r[1])}
    assert 0 < len(left) < len(rows)
    left = similar_lines(left.items())
    root = components(list(left.items()))
    left = {i: t for i, t in left.items() if root[i] == i}
    cut = {}
    for (i, t), (w, gone) in zip(left.items(), repeated_words(left.values())):
        cut[i] = [x for x, g in zip(w, gone) if not g] if any(gone) else None
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(by) == set(left)
    for i, t in left.items():
        if cut[i] is None:
            n = len(model.encode(t, add_special_tokens=False).ids) + 1
            assert sorted(by[i]) == packing.decompose(n)


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as node", "2 as row", "3 as toxicity_score", "4 as rest", "5 as th")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 0.5 * docs.count(), name
