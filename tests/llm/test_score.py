import math
import zlib
from collections import Counter

import numpy as np

from corpus import SCHEMA, corpus, lowered, sha, shingle_set, words
from nubila.llm import fingerprints, lm_score, toxicity


def test_fingerprints(spark):
    rows = corpus()
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = Counter()
    for k, t in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want[order[k][0], len(t), sha(e), *fingerprints.packed(fingerprints.low_bits([t, e])), ] += 1
    docs = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 5, 40):
        got = fingerprints.fingerprints_with_next(docs, parts=parts).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        by = {r.doc_id: r for r in got if r.doc_id is not None}
        for k, row in enumerate(order[:-1]):
            if row[0] is not None and order[k + 1][0] is not None and [r[0] for r in order].count(row[0]) == 1 and [r[0] for r in order].count(order[k + 1][0]) == 1:
                r = by[row[0]]
                assert math.isclose(r.near_edited, fingerprints.likeness_of(r.fingerprint, r.edited_fingerprint))
                assert math.isclose(r.near_next, fingerprints.likeness_of(r.fingerprint, by[order[k + 1][0]].fingerprint))
    one = fingerprints.fingerprints_with_next(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprints.fingerprints_with_next(spark.createDataFrame([], SCHEMA)).collect() == []


def test_likeness_estimates_jaccard():
    texts = [r[1] for r in corpus() if r[1] and len(words(r[1])) > 60]
    bits = fingerprints.low_bits(texts)
    errors = []
    for i in range(len(texts)):
        for j in range(i):
            a, b = shingle_set(texts[i]), shingle_set(texts[j])
            errors.append(fingerprints.likeness(bits[i], bits[j]) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.13


def test_lm_scores_by_the_words_themselves(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 5000)
    rows = corpus()
    # more distinct pairs than a table of fixed size keeps apart
    many = np.random.default_rng(3).integers(0, 40_000, (60, 10_000))
    rows += [(10_000 + k, " ".join(f"w{x}" for x in line), None, None, None, None, None) for k, line in enumerate(many)]
    target = [(1, rows[40][1]), (2, None), (3, rows[45][1])]
    grams = {t: list(zip([None, *w], w)) for t in {r[1] for r in rows} | {t for _, t in target} for w in [words(lowered(t))]}
    alone, known = [], set()
    for texts in ([t for _, t in target], [r[1] for r in rows]):
        pairs = Counter(g for t in texts for g in grams[t])
        w, c = Counter(), Counter()
        for (a, b), n in pairs.items():
            w[b] += n
            c[a] += n
        known |= set(w)
        alone.append((pairs, w, c, sum(w.values())))
    bits = lambda m, a, b: -math.log2(lm_score.WEIGHT * m[0][a, b] / max(m[2][a], 1) + (1 - lm_score.WEIGHT) * (m[1][b] + lm_score.ADD) / (m[3] + lm_score.ADD * len(known)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lm_score.counted_difference(docs, spark.createDataFrame(target, "id long, text string")).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = []
    for r in rows:
        g = grams[r[1]]
        t, b = (sum(bits(m, *x) for x in g) / len(g) if g else None for m in alone)
        want.append((r[0], len(g), t, b, t - b if g else None))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert all(x == y or abs(x - y) < 1e-6 for x, y in zip(a, b)), (a, b)
    empty = spark.createDataFrame([], "text string")
    assert lm_score.counted_difference(spark.createDataFrame([], SCHEMA), empty).collect() == []
    assert len({round(r.target_bits, 9) for r in lm_score.counted_difference(docs, empty).collect() if r.n_tokens}) == 1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id)
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.85 and hit / max((got.predicted == 1).sum(), 1) > 0.95
    assert got.score.between(0, 1).all()


def test_toxicity_edge_cases(spark):
    rows = corpus()
    labels = [(r[0], None if k % 7 == 0 else int("again" in (r[1] or ""))) for k, r in enumerate(rows)] + [(None, 1)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    assert len(toxicity.toxicity(docs, labels.limit(0)).collect()) == len(rows)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_automaton_finds_one_edit_and_quotes_count_apart():
    matcher = toxicity.Matcher(toxicity.Lexicon({"idiot": 5.0, "moron": 5.0, "scum": 4.0}, {"vequ": 3.0}))
    near = {w: (matcher.match(w) or ("", 0))[0] for w in ["idiot", "idiott", "idot", "ediot", "idoit", "morn", "scum", "scam", "vequx", "veq", "table"]}
    assert near == {"idiot": "exact", "idiott": "fuzzy", "idot": "fuzzy", "ediot": "fuzzy", "idoit": "", "morn": "fuzzy", "scum": "exact", "scam": "", "vequx": "stem", "veq": "", "table": ""}
    used = toxicity.features(matcher, "you are an idiot and a moron here today")
    told = toxicity.features(matcher, 'the page has "idiot" in it')
    assert used[0] > 0 and used[3] == 0 and told[0] == 0 and told[3] > 0


def test_words_that_a_stem_replaces_may_be_misspelled(spark):
    matcher = toxicity.Matcher(toxicity.Lexicon({"idiot": 5.0}, {"verachl": 4.0, "abc": 3.0}, {"verachlich": 6.0}))
    got = {w: matcher.match(w) for w in ["verachlich", "verahclich", "veraclich", "verachlixh", "verxchlkeit", "vrachlkeit", "verxcxlich", "abd", "idot"]}
    assert got["verachlich"] == got["verachlixh"] == ("stem", 4.0) and got["veraclich"] == ("fuzzy", 6.0) and got["idot"] == ("fuzzy", 5.0)
    assert got["verxchlkeit"] == got["vrachlkeit"] == ("fuzzy", 4.0)
    assert got["verahclich"] is got["verxcxlich"] is got["abd"] is None
    ends = ["lich", "keit", "bar", "los"]
    rows = [(f"plain text {k} verachl{ends[k % 4]}", 1) for k in range(40)] + [(f"plain text {k} fine", 0) for k in range(60)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert lexicon.stems and lexicon.replaced and (toxicity.Matcher(lexicon).match("vxrachllich") or ("",))[0] == "fuzzy"
