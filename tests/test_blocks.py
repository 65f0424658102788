"""Neighbours by blocks, positions without a task per group, trees and instances, against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubila.functions import keys
from nubila.operators import blocks, cells, instances, knn, ranks, trees, windows

POINT = "point_id long, batch int, x double, y double, z double"


def cloud(seed=0, n=400):
    """Two batches: a crowded place, a line, equal points, far outliers."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n, 3)), rng.normal(size=(n, 3)) * 0.01 + 3, np.column_stack([np.linspace(-9, 9, 60), np.zeros(60), np.zeros(60)]), np.ones((20, 3)), [[500.0, -300.0, 0.0], [501.0, -300.0, 0.0]]]
    xyz = np.concatenate(parts).round(3)
    batch = rng.integers(0, 2, len(xyz))
    return [(int(i * 3), int(b), *map(float, p)) for i, (b, p) in enumerate(zip(batch, xyz))]


def brute(queries, points, k, metric="l2", cells=None, cut=None):
    out = set()
    for qi, qb, *q in queries:
        near = []
        for si, sb, *s in points:
            if sb != qb:
                continue
            if cells is not None:
                size, shift, down = cells
                if any(abs((int((a + shift) // size) >> down) - (int((b + shift) // size) >> down)) > 1 for a, b in zip(q, s)):
                    continue
            d = [a - b for a, b in zip(q, s)]
            v = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] if metric == "l2" else abs(d[0]) + abs(d[1]) + abs(d[2])
            if cut is None or v < cut:
                near.append((v, si))
        out |= {(qi, r + 1, s, v) for r, (v, s) in enumerate(sorted(near)[:k])}
    return out


@pytest.mark.parametrize("size,at_once", [(512, 64), (16, 64), (16, 3)])
def test_nearest_matches_brute_force(spark, monkeypatch, size, at_once):
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    rows = cloud()
    df = spark.createDataFrame(rows, POINT).repartition(3)
    asked = ((blocks.Search(5), {}), (blocks.Search(4, cells=(0.5, 10.0, 1)), {"cells": (0.5, 10.0, 1)}), (blocks.Search(3, "l1"), {"metric": "l1"}), (blocks.Search(6, cut=0.25), {"cut": 0.25}))
    for search, how in asked if at_once == 3 else asked[:2]:
        got = {tuple(r) for r in blocks.nearest(df, search, size=size).collect()}
        assert got == brute(rows, rows, search.k, **how), how


def test_nearest_with_other_queries(spark):
    rows = cloud(1)
    asked = [(100_000 + i, i % 3, *map(float, p)) for i, p in enumerate(np.random.default_rng(2).normal(size=(50, 3)).round(2) * 4)]
    df, q = spark.createDataFrame(rows, POINT), spark.createDataFrame(asked, POINT)
    assert {tuple(r) for r in blocks.nearest(df, blocks.Search(7), q, size=32).collect()} == brute(asked, rows, 7)
    assert {tuple(r) for r in blocks.nearest(df, blocks.Search(2, cells=(0.3, 600.0, 0)), q, size=32).collect()} == brute(asked, rows, 2, cells=(0.3, 600.0, 0))


def test_nearest_of_few_points(spark):
    one = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 0, float("nan"), 0.0, 0.0), (3, 0, None, 0.0, 0.0)], POINT)
    assert [tuple(r) for r in knn.knn_exact(one, 3).collect()] == [(1, 1, 1, 0.0)]
    assert knn.knn_exact(one.where("point_id > 1"), 3).collect() == []
    same = spark.createDataFrame([(i, 0, 1.0, 1.0, 1.0) for i in range(50)], POINT)
    got = blocks.nearest(same, blocks.Search(3), size=8).collect()
    assert len(got) == 150 and {r.support_id for r in got} == {0, 1, 2}


def test_rounds_agree_with_blocks(spark):
    df = spark.createDataFrame(cloud(3, 60), POINT)
    want = {tuple(r) for r in knn.knn_exact(df, 4).collect()}
    assert {tuple(r)[:4] for r in knn.knn_exact(df, 4, rounds=True).collect()} == want


def test_running_positions_and_sums(spark):
    """One group with most of the rows, small ones, null keys, descending order: as a plain sort gives."""
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randint(0, 30), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, id long, v long").repartition(5)
    got = ranks.running(df, ["g"], ["-o", "id"], ("v",), parts=7).collect()
    want, groups = {}, defaultdict(list)
    for g, o, i, v in rows:
        groups[g].append((-o, i, v))
    for g, members in groups.items():
        total = 0
        for n, (_, i, v) in enumerate(sorted(members)):
            want[i] = (n, total)
            total += v
    assert {r.id: (r.position, r.v_before) for r in got} == want
    alone = ranks.running(df, [], ["id"], parts=7).collect()
    assert all(r.position == r.id for r in alone)
    assert ranks.running(df.where("id < 0"), ["g"], ["id"]).collect() == []


def test_with_groups_has_two_ways(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "g int, v int")
    groups = df.groupBy("g").agg(F.sum("v").alias("s"))
    for most in (0, 10):
        assert sorted(map(tuple, ranks.with_groups(df, groups, ["g"], most).collect()), key=str) == [(1, 5, 11), (1, 6, 11), (None, 7, 7)]


def test_hilbert_round_trip_and_steps(spark):
    depth = 4
    df = spark.range(1 << (3 * depth)).select(F.col("id").alias("key"))
    at = keys.hilbert_decode(df, "key", depth)
    rows = keys.hilbert(at, "gx", "gy", "gz", depth, "again").orderBy("key").collect()
    assert all(r.key == r.again for r in rows)
    # a curve: each step goes to a neighbouring cell
    assert all(sum(abs(a[c] - b[c]) for c in ("gx", "gy", "gz")) == 1 for a, b in zip(rows, rows[1:]))


def test_serialization_depth_follows_cells(spark):
    df = spark.createDataFrame([(i, 0, i % 5, i % 3, 0) for i in range(30)], "point_id long, batch int, gx long, gy long, gz long")
    rows = cells.serialization(df).collect()
    assert {r.depth for r in rows} == {3} and len(rows) == 120
    for order in ("z", "z-trans", "hilbert", "hilbert-trans"):
        mine = sorted((r for r in rows if r.order == order), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(30)) and [(r.code, r.point_id) for r in mine] == sorted((r.code, r.point_id) for r in mine)
    with pytest.raises(ValueError):
        cells.serialization(df, depth=17)


def test_octree_links(spark):
    rng = random.Random(2)
    pts = [(i, i % 2, rng.randint(0, 20), rng.randint(0, 9), rng.randint(0, 30)) for i in range(60)]
    rows = trees.octree_nodes(spark.createDataFrame(pts, "point_id long, batch int, gx long, gy long, gz long"), full_depth=1).collect()
    by = {(r.level, r["index"]): r for r in rows}
    assert len(by) == len(rows)
    depth = max(r.level for r in rows)
    assert depth == 5
    for level in range(depth + 1):
        at = sorted(r["index"] for r in rows if r.level == level)
        assert at == list(range(len(at)))
        assert sum(r.points for r in rows if r.level == level) == 60
    for r in rows:
        if r.level:
            up = by[r.level - 1, r.parent]
            assert up.batch == r.batch and up.key == r.key >> 3 and (up.mask >> (r.key & 7) & 1) == (r.points > 0)
        if r.level >= 1 and r.child >= 0:
            kids = [by[r.level + 1, 8 * r.child + o] for o in range(8)]
            assert all(k.parent == r["index"] and k.key == 8 * r.key + o for o, k in enumerate(kids)) and sum(k.points for k in kids) == r.points
        if r.level == depth and r.points:
            assert r.points == sum((r.batch, r.x, r.y, r.z) == p[1:] for p in pts)
    cell, shape = trees.sparse_tensor(spark.createDataFrame(pts, "point_id long, batch int, gx long, gy long, gz long"), pad=4)
    assert shape == tuple(max(p[i] for p in pts) + 4 for i in (2, 3, 4)) and sorted(r.row for r in cell.collect()) == list(range(60))


def slow_ap(truth, masks, preds, thresholds, least):
    """Average precision one scene, class and threshold after the other, straight from sets of points."""
    out = {}
    scenes = {t[0] for t in truth}
    points = defaultdict(dict)
    for s, p, seg, inst in truth:
        points[s][p] = (seg, inst)
    mask = defaultdict(set)
    for s, pred, p in masks:
        mask[s, pred].add(p)
    classes = {c for *_, c, _ in preds} | {t[2] for t in truth if t[2] >= 0}
    for cls, th in itertools.product(classes, thresholds):
        scored, missed, any_true, any_pred = [], 0, False, False
        for s in scenes:
            members = defaultdict(set)
            for p, (seg, inst) in points[s].items():
                members[inst].add(p)
            true = {i: m for i, m in sorted(members.items()) if i != -1 and points[s][min(m)][0] == cls}
            mine = {p: (mask[s, p], score) for s2, p, c, score in sorted(preds) if s2 == s and c == cls and len(mask[s, p]) >= least}
            any_pred |= bool(mine)
            used, over = set(), lambda a, b: len(a & b) / len(a | b)
            for i, m in true.items():
                if len(m) < least:
                    continue
                any_true = True
                free = [p for p, (pm, _) in mine.items() if p not in used and over(m, pm) > th]
                if not free:
                    missed += 1
                    continue
                used.add(free[0])
                scores = sorted((mine[p][1] for p in free), reverse=True)
                scored += [(scores[0], 1)] + [(v, 0) for v in scores[1:]]
            for p, (pm, score) in mine.items():
                if any(over(m, pm) > th for m in true.values()):
                    continue
                waste = sum(points[s][x][0] < 0 for x in pm) + sum(len(m & pm) for m in true.values() if len(m) < least)
                if waste / len(pm) <= th:
                    scored.append((score, 0))
        if not any_true:
            if any_pred:
                out[cls, th] = None
            continue
        total = sum(h for _, h in scored) + missed
        curve = [(1.0, 0.0)]
        for cut in sorted({v for v, _ in scored}, reverse=True):
            kept = [h for v, h in scored if v >= cut]
            curve.append((sum(kept) / len(kept), sum(kept) / total))
        out[cls, th] = sum((p + q) / 2 * (b - a) for (p, a), (q, b) in zip(curve, curve[1:]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_instance_ap_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    truth, masks, preds = [], [], []
    for s in range(3):
        instance = {}
        for p in range(160):
            inst = rng.choice([-1, *range(12)]) if rng.random() < 0.3 else (p // 12)
            seg = instance.setdefault(inst, rng.choice([-1, 0, 0, 1, 2]))
            truth.append((s, p, seg, inst))
        for k in range(30):
            start, width = rng.randrange(0, 150), rng.choice([4, 8, 12, 16, 24, 30])
            preds.append((s, k, rng.choice([-1, 0, 0, 1, 2]), rng.choice([0.1, 0.4, 0.5, 0.8])))
            masks += [(s, k, p) for p in range(start, min(160, start + width)) if rng.random() < 0.9]
    t = spark.createDataFrame(truth, "scene int, point_id long, segment int, instance int")
    m = spark.createDataFrame(masks, "scene int, pred_id int, point_id long")
    p = spark.createDataFrame(preds, "scene int, pred_id int, class int, score double")
    thresholds = (0.1, 0.25, 0.5, 0.75)
    got = {(r["class"], r.threshold): r.ap for r in instances.instance_ap(t, m, p, thresholds=thresholds, least=5).collect()}
    want = slow_ap(truth, masks, [x for x in preds if x[2] >= 0], thresholds, 5)
    assert set(got) == set(want)
    for key, v in want.items():
        assert (got[key] is None) == (v is None) and (v is None or abs(got[key] - v) < 1e-9), key


def test_elastic_moves_equal_points_alike(spark):
    df = spark.createDataFrame([(i, i % 2, float(i // 4), 1.5, 2.0) for i in range(40)], POINT)
    moved = {r.point_id: r for r in windows.elastic(df, 1.0, 0.5, 3).collect()}
    assert len(moved) == 40
    for i in range(0, 40, 4):
        assert np.isclose(moved[i].x, moved[i + 2].x) and np.isclose(moved[i].y, moved[i + 2].y)
    assert any(abs(moved[i].y - 1.5) > 1e-3 for i in range(40)) and all(abs(moved[i].y - 1.5) < 1.5 for i in range(40))


def test_partners_send_only_points_within_reach():
    import pyarrow as pa

    xyz = np.array([[0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [1.0, 1.0, 1.5], [-0.1, 0.5, 0.5]])
    box = {"qlx": 0.0, "qly": 0.0, "qlz": 0.0, "qhx": 1.0, "qhy": 1.0, "qhz": 1.0}
    near = {"q": 1, "j": 0, "raw": blocks._bytes(np.array([7, 8, 9, 10]), xyz), "n": 4} | box
    far = {"q": 2, "j": 0, "raw": blocks._bytes(np.array([11]), xyz[:1] + 5), "n": 1} | box
    (got,) = blocks._trimmed(iter([pa.RecordBatch.from_pylist([near, far])]))
    (row,) = got.to_pylist()
    assert (row["q"], row["n"]) == (1, 2)
    ids, kept = blocks._points(row["raw"], 2)
    assert ids.tolist() == [7, 8] and kept.tolist() == xyz[:2].tolist()


@pytest.mark.parametrize("low, also, cells", ((0.0, None, None), (0.05, 1e-5, None), (0.05, 0.09, (0.3, 1.0, 0))))
def test_pairs_are_listed_from_both_ends(spark, monkeypatch, low, also, cells):
    """Several blocks and tiles, runs that don't come out even, points at one place, rows of one id, two clouds."""
    monkeypatch.setattr(blocks, "WIDE", 32)
    monkeypatch.setattr(blocks, "TILE", 2)
    monkeypatch.setattr(blocks, "STEP", 640)
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.random((300, 3)).astype("f4"), np.full((40, 3), 0.5), rng.random((5, 3))]).astype(float)
    ids, batch = np.arange(len(xyz)), np.arange(len(xyz)) % 7 // 6
    ids[-1] = 3
    points = spark.createDataFrame([(int(i), int(b), *map(float, p)) for i, b, p in zip(ids, batch, xyz)], "point_id long, batch int, x double, y double, z double")
    d = sum((xyz[:, None, a] - xyz[None, :, a]) ** 2 for a in range(3))
    stays = ((d < 0.09) & (d >= low) | (d <= (-1 if also is None else also))) & (batch[:, None] == batch[None, :])
    if cells is not None:
        c = np.floor((xyz + cells[1]) / cells[0])
        stays &= (np.abs(c[:, None] - c[None, :]) <= 1).all(2)
    i, j = np.nonzero(stays)
    got = blocks.within(points, low, 0.09, also, cells=cells).collect()
    assert sorted(map(tuple, got)) == sorted(zip(ids[i].tolist(), ids[j].tolist(), d[i, j].tolist()))


def test_listed_pairs_are_written_compactly(spark, tmp_path):
    """A distance has 8 bytes and is that of two rows, which lie so near each other that the writer finds it again."""
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(rng.random((5000, 3)))], "point_id long, batch int, x double, y double, z double")
    blocks.within(points, 0.0, 0.09, None).write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 1_000_000 and sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 7 * n
