import hashlib

import numpy as np
from pyspark.sql import functions as F

from nubila.llm import clustering as C


def brute_force(rows, k, dim, rounds, scale, seed=2):
    """All distances in every round, with Python's integers; rows are (id, vector)."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centroids)]
    found = [(i, nearest(v)) for i, v in kept]
    inertia = [sum(d for _, (d, j) in found if j == c) for c in range(len(centroids))]
    return sorted(((i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, (d, j) in found), key=repr)


def vectors():
    """Rows with ties, repeats, null and repeated ids, null vectors, wrong sizes and components that are null or not finite."""
    rng = np.random.default_rng(3)
    middle = rng.integers(-9, 9, (7, 4)).astype(float)
    rows = [(i * 2, (middle[i % 7] + rng.normal(size=4) * 1.5).round(1).tolist()) for i in range(240)]
    rows += [rows[5], rows[5], (11, rows[9][1]), (None, rows[30][1]), (None, rows[31][1]), (None, rows[31][1])]
    rows += [(500 + i, [float(i % 3), 0.0, 0.0, float(i % 2)]) for i in range(40)]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0]), (905, [1.0, float("nan"), 1.0, 1.0]), (906, [1.0, float("inf"), 1.0, 1.0]), (907, [float("-inf")] * 4)]
    return rows


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "c", 5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, did int")
    return sorted((tuple(r) for r in C.centroid_clusters(df.repartition(3), **how).collect()), key=repr)


def test_clusters_match_brute_force(spark, monkeypatch):
    rows = vectors()
    assert got(spark, rows, k=24, dim=4, rounds=5, scale=10) == brute_force(rows, 24, 4, 5, 10)
    monkeypatch.setattr(C, "BLOCK", 16)
    assert got(spark, rows, k=3, dim=4, rounds=2, scale=1) == brute_force(rows, 3, 4, 2, 1)
    assert got(spark, rows, k=30, dim=4, rounds=0, scale=2) == brute_force(rows, 30, 4, 0, 2)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-(1 << 26), 1 << 26, 3)).astype(float).tolist()) for i in range(90)]
    assert got(spark, rows, k=12, dim=3, rounds=3, scale=1) == brute_force(rows, 12, 3, 3, 1)


def test_few_vectors_and_none(spark):
    few = [(4, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [5.0, 5.0])]
    assert got(spark, few, k=40, dim=2, rounds=5, scale=1) == brute_force(few, 40, 2, 5, 1)
    assert got(spark, [(1, None)], dim=2) == [] and got(spark, [], dim=2) == []


def test_bounds_rule_out_most_distances():
    """Bounds give the same clusters as all distances, and spare most of these."""
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(40, 16)) * 300
    x = np.floor(middle[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 40).astype(np.int64)
    centroids = x[:40].copy()
    group = C.grouped(centroids, 4)
    state, measured = C.assign_all(x, centroids, group), []
    for _ in range(6):
        cluster = state[0]
        moved = np.array([x[cluster == c].sum(0) // max((cluster == c).sum(), 1) if (cluster == c).any() else centroids[c] for c in range(40)])
        drift = np.sqrt(((moved - centroids).astype(float) ** 2).sum(1)) * (1 + 1e-12)
        centroids = moved
        *state, n = C.reassign(x, *state, centroids, drift, group)
        measured.append(n)
        d = C.squared(x, centroids)
        assert (state[0] == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(len(x)), state[0]].astype(float))
        assert (state[1] >= own - 1e-6).all()
        for g in range(state[2].shape[1]):
            others = np.where((group == g) & (np.arange(40) != state[0][:, None]), np.sqrt(d.astype(float)), np.inf).min(1)
            assert (state[2][:, g] <= others + 1e-6).all()
    assert measured[-1] < 0.3 * 4000 * 40


def test_query_matches_sql(spark):
    import duckdb

    from nubila.llm import queries

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op11_centroid_clusters"])
    out = queries.queries()["op11_centroid_clusters"](spark, sf)
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())
    assert out.count() == spark.read.parquet(f"{sf}/embeddings.parquet").where(F.size("embedding") == 64).count()


def test_bounds_keep_the_centroid_that_a_vector_left():
    """A vector that goes to an earlier group's centroid still has its old one among the others of a later group."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        x = np.floor(100 * rng.normal(size=(300, 4))).astype(np.int64)
        centroids, rows = x[:24].copy(), np.arange(len(x))
        group = C.grouped(centroids, 6)
        state = C.assign_all(x, centroids, group)
        for _ in range(6):
            moved = centroids + rng.integers(-40, 40, centroids.shape)
            drift = np.sqrt(((moved - centroids).astype(float) ** 2).sum(1)) * (1 + 1e-12)
            centroids = moved
            *state, _ = C.reassign(x, *state, centroids, drift, group)
            far = C.squared(x, centroids)
            assert (state[0] == far.argmin(1)).all()
            far = np.sqrt(far.astype(float))
            far[rows, state[0]] = np.inf
            assert all((state[2][:, g] <= far[:, group == g].min(1) + 1e-6).all() for g in np.unique(group))
