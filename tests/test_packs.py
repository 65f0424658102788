"""Radius queries and inverted lists settle their hits inside tasks: no pair is listed, results as by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubila.operators import ball, blocks, cluster, knn, windows

POINT = "point_id long, batch int, x double, y double, z double"


def scattered(spark, n=160, seed=4):
    """Crowded places, lone points, copies, negative coordinates and two batches."""
    rng = np.random.default_rng(seed)
    xyz = np.concatenate([rng.normal(0, 0.05, (n // 2, 3)), rng.uniform(-1, 1, (n - n // 2, 3))])
    xyz[5:15] = xyz[4]
    rows = [(int(i) * 3, int(i % 7 == 0), *map(float, p)) for i, p in zip(rng.permutation(n), xyz)]
    return spark.createDataFrame(rows, POINT), rows


def hits_of(q, rows, low, high):
    found = []
    for i, b, *p in rows:
        d = [u - v for u, v in zip(q[2:], p)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        if b == q[1] and (low <= d2 < high or low > 0 and d2 <= 1e-5):
            found.append((i, d2))
    return sorted(found)


@pytest.mark.parametrize("mode", ["first", "random", "even", "nearest"])
def test_ball_query_lists_no_pairs(spark, monkeypatch, mode):
    points, rows = scattered(spark)
    monkeypatch.setattr(ball, "HEADS", 2)
    monkeypatch.setattr(ball, "MORE", 3)
    monkeypatch.setattr(ball, "PACK", 8)
    monkeypatch.setattr(ball, "hits", None)
    low = 0.0 if mode == "nearest" else 0.04
    asked = points.where("point_id % 2 = 0")
    got = sorted(map(tuple, ball.ball_query(points, 0.2, 3, mode=mode, seed=5, queries=asked, min_radius=low, shift=1.0).collect()))
    want = []
    for q in (r for r in rows if r[0] % 2 == 0):
        near = hits_of(q, rows, low * low, 0.2 * 0.2)
        order = {"random": lambda h: ((h[0] * 1103515245 + 12345 + 5) % 2147483648, h[0]), "nearest": lambda h: (h[1], h[0])}.get(mode, lambda h: h[0])
        near.sort(key=order)
        if mode == "even" and len(near) > 3:
            near = [near[len(near) * i // 3] for i in range(3)]
        want += [(q[0], i + 1, *h) for i, h in enumerate(near[:3])]
    assert got == sorted(want)


def test_l1_and_matches_list_no_pairs(spark, monkeypatch):
    points, rows = scattered(spark)
    monkeypatch.setattr(ball, "hits", None)
    monkeypatch.setattr(ball, "candidates", None)
    got = sorted(map(tuple, ball.radius_l1(points, 0.3, 4, shift=1.0).collect()))
    want = []
    for q in rows:
        near = sorted((abs(q[2] - p[0]) + abs(q[3] - p[1]) + abs(q[4] - p[2]), i) for i, b, *p in rows if b == q[1])
        want += [(q[0], n + 1, i, d) for n, (d, i) in enumerate(near[:4]) if d < 0.3]
    assert got == sorted(want)
    assert ball.match_pairs(points.where("point_id % 2 = 0"), points, 2, 0.2).count() == sum(r[0] % 2 == 0 for r in rows)


def test_inverted_lists_list_no_pairs(spark, monkeypatch):
    points, rows = scattered(spark)
    monkeypatch.setattr(knn, "square", None)
    centres = np.array([r[2:] for r in rows[::20]])
    far = {r[0]: ((np.array(r[2:]) - centres) ** 2).sum(1) for r in rows}
    own = {i: int(d.argmin()) for i, d in far.items()}
    want = []
    for q in rows:
        lists = set(np.argsort(far[q[0]], kind="stable")[:3].tolist())
        near = sorted((d2, i) for i, d2 in hits_of(q, [r for r in rows if own[r[0]] in lists], 0, np.inf))
        want += [(q[0], n + 1, i, d2) for n, (d2, i) in enumerate(near[:5])]
    assert sorted(map(tuple, knn.knn_ivf(points, 5, probe=3, centres=centres).collect())) == sorted(want)


def test_components_list_no_pairs(spark, monkeypatch):
    _, rows = scattered(spark, 260)
    monkeypatch.setattr(ball, "candidates", None)
    rows += [(1001, 0, 5.0, 0.0, 0.0), (1002, 0, 5.25, 0.0, 0.0), (1003, 0, 5.499, 0.0, 0.0), (1004, 0, 5.0, 0.2499, 0.0)]
    points = spark.createDataFrame([(*r, r[0] % 2 if r[0] < 1000 else None if r[0] == 1004 else 0) for r in rows], POINT + ", label int")
    names = {r[0]: r[0] for r in rows}
    label = lambda i: i % 2 if i < 1000 else None if i == 1004 else 0
    for _ in rows:
        for r in rows:
            near = [i for i, _ in hits_of(r, rows, 0, 0.25 * 0.25) if label(i) == label(r[0]) is not None] or [r[0]]
            least = min(names[i] for i in near)
            names.update({i: min(names[i], least) for i in near})
    got = {r.point_id: (r.cluster, r.cnt) for r in cluster.label_clusters(points, 0.25, shift=1.0).collect()}
    assert got == {i: (c, list(names.values()).count(c)) for i, c in names.items()}


def test_adaptive_search_lists_no_pairs(spark, monkeypatch):
    points, rows = scattered(spark)
    monkeypatch.setattr(knn, "square", None)
    from nubila.operators.cells import octree_select

    level = {r.point_id: r.level for r in octree_select(points, 0.05, 4, 3, shift=1.0).collect()}
    want = []
    for q in rows:
        cell = lambda p: [int((c + 1.0) // 0.05) >> level[q[0]] for c in p]  # noqa: B023, E731
        near = [r for r in rows if all(abs(u - v) <= 1 for u, v in zip(cell(q[2:]), cell(r[2:])))]
        want += [(q[0], n + 1, i, d2) for n, (d2, i) in enumerate(sorted((d2, i) for i, d2 in hits_of(q, near, 0, np.inf))[:3])]
    assert len(set(level.values())) > 1
    assert sorted(map(tuple, knn.knn_adaptive(points, 3, 0.05, 4, shift=1.0).collect())) == sorted(want)


@pytest.mark.parametrize("low", (0.0, 0.05))
def test_hits_of_a_crowded_cell_come_from_many_tasks(spark, monkeypatch, low):
    monkeypatch.setattr(blocks, "WIDE", 16)
    monkeypatch.setattr(blocks, "TASK", 1 << 10)
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, *map(float, rng.random(3) * 0.2)) for i in range(200)] + [(200, None, 0.1, 0.1, 0.1), (201, 0, None, 0.1, 0.1), (202, 0, float("nan"), 0.1, 0.1)]
    points = spark.createDataFrame(rows, "point_id int, batch int, x double, y double, z double")
    got = ball.hits(points, 0.12, min_radius=low)
    assert got.dtypes == [("query_id", "int"), ("support_id", "int"), ("d2", "double")]
    want = []
    for a in rows[:200]:
        for b in rows[:200]:
            x, y, z = (a[i] - b[i] for i in (2, 3, 4))
            d = x * x + y * y + z * z
            if a[1] == b[1] and (low * low <= d < 0.12 * 0.12 or low and d <= 1e-5):
                want.append((a[0], b[0], d))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.select(F.spark_partition_id()).distinct().count() > 8


def test_hits_closer_than_the_least_distance_stay_among_27_cells(spark):
    # the SQL's fixed 1e-5 is beyond this radius: only cells bound it
    points = spark.createDataFrame([(i, 0, v, 0.0, 0.0) for i, v in enumerate((0.0, 0.0015, 0.0025))], "point_id long, batch int, x double, y double, z double")
    got = {(r.query_id, r.support_id) for r in ball.hits(points, 0.001, min_radius=0.0005).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0), (1, 2), (2, 1)}


@pytest.mark.parametrize("small", (None, 0.1))
def test_pairs_of_a_crowded_window_come_from_many_tasks(spark, monkeypatch, small):
    monkeypatch.setattr(blocks, "WIDE", 16)
    monkeypatch.setattr(blocks, "TASK", 1 << 10)
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, *map(float, rng.random(3) * (0.2 if i < 150 else 1.0) - 0.4)) for i in range(200)] + [(200, 0, None, 0.1, 0.1), (201, None, 0.1, 0.1, 0.1)]
    points = spark.createDataFrame(rows, "point_id int, batch int, x double, y double, z double")
    got = windows.window_pairs(points, 0.2, small, 1.0)
    cell = lambda r, e: tuple(int(np.floor((v + 1.0) / e)) for v in r[2:])
    want = [(a[0], b[0]) for a in rows[:200] for b in rows[:200] if a[1] == b[1] and cell(a, 0.2) == cell(b, 0.2) and (not small or cell(a, small) != cell(b, small))]
    assert got.dtypes == [("query_id", "int"), ("support_id", "int")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.select(F.spark_partition_id()).distinct().count() > 8
