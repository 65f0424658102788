"""Poses, inverted lists, keyed tables, colours and set checks on small tables."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubila.functions import transforms
from nubila.operators import cluster, knn, neighbors, poses, records
from nubila.sources.sinks import KeyedTable

POINT = "point_id long, batch int, x double, y double, z double"


def _matrix(t, q):
    w, x, y, z = q
    m = np.eye(4)
    m[:3, :3] = [[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]]
    m[:3, 3] = t
    return m


def test_sweep_chain_follows_links(spark):
    """Two chains of different lengths, a frame alone, a link to a frame that isn't there."""
    rng = random.Random(4)
    links = {f"a{i}": f"a{i - 1}" if i else None for i in range(7)} | {"b0": None, "b1": "b0", "alone": None, "lost": "gone"}
    unit = lambda: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([rng.gauss(0, 1) for _ in range(4)])
    car = {k: ([rng.uniform(-5, 5) for _ in range(3)], unit()) for k in links}
    sensor = {k: ([rng.uniform(-1, 1) for _ in range(3)], unit()) for k in links}
    at = {k: 100 + 10 * i for i, k in enumerate(links)}
    rows = [(k, p, at[k], *car[k], *sensor[k]) for k, p in links.items()]
    df = spark.createDataFrame(rows, "token string, prev string, ts long, ct array<double>, cq array<double>, st array<double>, sq array<double>")
    frames = df.select("token", "prev", "ts", poses.matrix(F.col("ct"), F.col("cq")).alias("car_pose"), poses.matrix(F.col("st"), F.col("sq")).alias("sensor_pose"))
    got = {(r.token, r.step): r for r in poses.sweep_chain(frames, 6).collect()}
    assert len(got) == len(links) * 5
    world = {k: _matrix(*car[k]) @ _matrix(*sensor[k]) for k in links}
    for k in links:
        now, last = k, None
        for step in range(1, 6):
            if links.get(now) in links and links[now] is not None:
                now = last = links[now]
            r = got[k, step]
            assert r.sweep == (last or k) and r.lag == (at[k] - at[last] if last else 0)
            if last is None:
                assert r.transform is None
            else:
                assert np.allclose(np.array(r.transform).reshape(4, 4), np.linalg.inv(world[k]) @ world[last])
    p = spark.createDataFrame([(1.0, 2.0, 3.0, _matrix([1, 0, 0], [1, 0, 0, 0]).ravel().tolist()), (1.0, 2.0, 3.0, None)], "x double, y double, z double, transform array<double>")
    assert [tuple(r)[:3] for r in poses.moved(p).collect()] == [(2.0, 2.0, 3.0), (1.0, 2.0, 3.0)]


def test_recall_of_lists_is_that_of_searches(spark):
    """The recalls of all numbers of lists at once are those of a search with each."""
    rng = np.random.default_rng(0)
    rows = [(i, 0, *map(float, p)) for i, p in enumerate(rng.normal(size=(200, 3)).round(2))]
    df = spark.createDataFrame(rows, POINT)
    centres = rng.normal(size=(6, 3))
    exact = knn.knn_exact(df, 5)
    got = {r.nprobe: (r.mean_recall, r.min_recall) for r in knn.ivf_recall(df, exact, centres, 5).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and got[6] == (1.0, 1.0)
    true = {(r.query_id, r.support_id) for r in exact.collect()}
    for probe in (1, 3):
        found = {}
        for r in knn.knn_ivf(df, 5, probe=probe, centres=centres).collect():
            found[r.query_id] = found.get(r.query_id, 0) + ((r.query_id, r.support_id) in true)
        share = [found.get(i, 0) / 5 for i in range(200)]
        assert abs(np.mean(share) - got[probe][0]) < 1e-9 and min(share) == got[probe][1]
    table = spark.createDataFrame([(1, 0.2, 0.0), (2, 0.6, 0.1), (3, 0.8, 0.2)], "nprobe int, mean_recall double, min_recall double")
    chosen = lambda t: [r.nprobe for r in knn.calibrated(table, t).collect() if r.chosen]
    assert chosen(0.5) == [2] and chosen(0.8) == [3] and chosen(0.95) == [3] and chosen(0.1) == [1]


def test_head_attention_matches_numpy(spark):
    rng = np.random.default_rng(1)
    n, heads, dim, levels = 12, 2, 3, 5
    xyz = rng.normal(size=(n, 3))
    q, k, v = rng.normal(size=(3, n, heads, dim))
    tables = rng.normal(size=(3, 3, levels, heads, dim))
    pairs = [(i, int(j)) for i in range(n) for j in rng.choice(n, 4, replace=False)]
    features = lambda a: spark.createDataFrame([(i, h, a[i, h].tolist()) for i in range(n) for h in range(heads)], "point_id long, head int, value array<double>")
    table = lambda t: spark.createDataFrame([(a, r, h, tables[t, a, r, h].tolist()) for a in range(3) for r in range(levels) for h in range(heads)], "axis int, rel_index int, head int, value array<double>")
    points = spark.createDataFrame([(i, 0, *map(float, xyz[i])) for i in range(n)], POINT)
    edges = spark.createDataFrame(pairs, "query_id long, support_id long")
    places = neighbors.relative_places(edges, points, 0.7, levels)
    bias = neighbors.head_bias(places, [("query_id", features(q), table(0)), ("support_id", features(k), table(1))])
    both = neighbors.head_relation(edges, features(q), features(k)).join(bias, ["query_id", "support_id", "head"]).withColumn("relation", F.col("relation") + F.col("bias"))
    out = {(r.query_id, r["head"], r["c"]): r.value for r in neighbors.head_values(neighbors.head_softmax(both), features(v), places, table(2)).collect()}
    for i in range(n):
        mine = [j for a, j in pairs if a == i]
        for h in range(heads):
            rel, val = [], []
            for j in mine:
                at = np.clip(np.floor((xyz[i] - xyz[j]) / 0.7).astype(int) + levels // 2, 0, levels - 1)
                rel.append(q[i, h] @ k[j, h] + sum(q[i, h] @ tables[0, a, at[a], h] + k[j, h] @ tables[1, a, at[a], h] for a in range(3)))
                val.append(v[j, h] + sum(tables[2, a, at[a], h] for a in range(3)))
            w = np.exp(np.array(rel) - max(rel))
            assert np.allclose([out[i, h, c] for c in range(dim)], (w / w.sum()) @ np.array(val))


def test_collated_indices_name_the_same_points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), *map(float, p)) for i, p in enumerate(rng.random((60, 3)))]
    df = spark.createDataFrame(rows, POINT)
    sizes, indices = cluster.local_hierarchy(df, (0.4,), 2)
    n = {(r.sample, r.level): r.n for r in sizes.collect()}
    got = cluster.collate(sizes, indices).collect()
    total = {level: sum(v for (_, l), v in n.items() if l == level) for level in (0, 1)}
    assert n[0, 0] + n[1, 0] + n[2, 0] == 60 and total[1] < 60
    for r in got:
        rows_level, target_level = {"knn": (r.level, r.level), "sub": (r.level, r.level - 1), "back": (r.level - 1, r.level)}[r.kind]
        assert 0 <= r.row < total[rows_level] and 0 <= r.target < total[target_level]
    assert sorted(r.row for r in got if r.kind == "back") == list(range(60)) and sorted(r.row for r in got if r.kind == "sub") == list(range(total[1]))
    # the nearest neighbour within a level is the point itself, in the same sample
    assert all(r.row == r.target for r in got if r.kind == "knn" and r.slot == 0)


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ("k",))
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    assert t.read() is None and t.version() == 0
    assert t.upsert(make((1, "a"), (2, "b"), (None, "n"))) == 1
    assert t.upsert(make((2, "c"), (3, "d"))) == 2
    rows = lambda version=None: sorted(map(tuple, t.read(version).collect()), key=str)
    assert rows() == [(1, "a"), (2, "c"), (3, "d"), (None, "n")] and rows(1) == [(1, "a"), (2, "b"), (None, "n")]
    with pytest.raises(ValueError, match="conflicting"):
        t.upsert(make((2, "other")), conflict="error")
    assert t.upsert(make((2, "c"), (4, "e")), conflict="error") == 3 and t.upsert(make((1, "z")), conflict="skip") == 4
    with pytest.raises(ValueError, match="unique"):
        t.upsert(make((9, "a"), (9, "b")))
    before = rows()
    assert t.compact() == 5 and rows() == before and len(t.layers()) == 1
    assert [r.k for r in t.remaining(make((1, "x"), (8, "y"))).collect()] == [8]
    # of two writers that began alike, the second one fails and leaves the table as it is
    with pytest.raises(RuntimeError, match="another writer"):
        t.upsert(make((20, "mine")), before_commit=lambda: t.upsert(make((21, "theirs"))))
    assert rows() == sorted([*before, (21, "theirs")], key=str)


def test_a_killed_writer_leaves_the_table_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    t = KeyedTable(spark, path, ("k",))
    t.upsert(spark.createDataFrame([(1, "a")], "k int, v string"))
    code = f"""
import os
from pyspark.sql import SparkSession
from nubila.sources.sinks import KeyedTable
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
KeyedTable(spark, {path!r}, ("k",)).upsert(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), before_commit=lambda: os.kill(os.getpid(), 9))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=120)
    assert done.returncode == -9, done.stderr[-500:]
    assert len(os.listdir(f"{tmp_path}/t/data")) == 2 and [tuple(r) for r in t.read().collect()] == [(1, "a")]
    assert t.upsert(spark.createDataFrame([(2, "c")], "k int, v string")) == 2
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c")]


def test_color_jitter_orders_differ_and_matter(spark):
    rows = [(i, b, float((37 * i) % 256), float((91 * i + 40) % 256), float((11 * i + 200) % 256)) for i in range(40) for b in range(8)]
    df = spark.createDataFrame(rows, "point_id long, batch int, r double, g double, b double")
    plan = df.select("batch").distinct().withColumns(transforms.jitter_plan(2, {n: (0.5, 1.5) for n in transforms.JITTERS})).collect()
    orders = {tuple(r[f"__p{i}"] for i in range(4)) for r in plan}
    assert len(orders) > 2 and all(sorted(o) == [0, 1, 2, 3] for o in orders)
    out = transforms.random_color_jitter(df, 0.3, 0.3, 0.3, 0.1, seed=2).collect()
    assert len(out) == 320 and all(0 <= r[c] <= 255 for r in out for c in "rgb")
    same = transforms.random_color_jitter(df, seed=2).collect()
    assert sorted(map(tuple, same)) == sorted(rows)
    none = transforms.random_color_jitter(df, 0.3, 0.3, 0.3, 0.1, p=0.0).collect()
    assert sorted(map(tuple, none)) == sorted(rows)
    with pytest.raises(ValueError):
        transforms.random_color_jitter(df, hue=0.6)


def test_set_checks_keep_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (None, "y")], "k int, v string")
    assert records.key_differences(a, a, ("k",)).collect() == []
    assert records.identity_mismatches(a.distinct(), a.distinct(), ("k",), ("v",)).collect() == []
    assert sorted(map(tuple, records.multiset_common(a, a, ("k",)).collect()), key=str) == [(1, 1), (None, 2)]
    assert records.lacking(a, "v", ("y",), ("k",)).collect()[0].k == 1
    b = spark.createDataFrame([(None, "z"), (2, "x")], "k int, v string")
    got = sorted(map(tuple, records.identity_mismatches(a.distinct(), b, ("k",), ("v",)).collect()), key=str)
    assert got == [(1, "left"), (2, "right"), (None, "fields")]


def test_array_clouds(spark, tmp_path):
    """Folders of arrays by split; labels that are missing are -1, other fields null; clouds can be chosen by name."""
    from nubila.sources import readers

    rng = np.random.default_rng(0)
    for split, cloud, fields in (("train", "a", ("coord", "color", "segment")), ("train", "b", ("coord", "normal", "instance")), ("val", "c", ("coord",)), ("test", "d", ("coord",))):
        folder = tmp_path / split / cloud
        folder.mkdir(parents=True)
        for f in fields:
            value = rng.normal(size=(5, 3)).astype(np.float32) if f in ("coord", "normal") else rng.integers(0, 9, (5, 3) if f == "color" else 5)
            np.save(folder / f"{f}.npy", value)
        np.save(folder / "other.npy", np.zeros(5))
    got = readers.array_clouds(spark, f"file://{tmp_path}", splits=("train", "val")).collect()
    assert len(got) == 15 and {(r.split, r.cloud) for r in got} == {("train", "a"), ("train", "b"), ("val", "c")}
    coord = np.load(tmp_path / "train" / "a" / "coord.npy")
    for r in got:
        if r.cloud == "a":
            assert np.allclose([r.x, r.y, r.z], coord[r.row]) and r.segment == np.load(tmp_path / "train" / "a" / "segment.npy")[r.row] and r.instance == -1 and r.nx is None
        if r.cloud == "b":
            assert r.segment == -1 and r.instance >= 0 and r.r is None and r.nx is not None
    assert {r.cloud for r in readers.array_clouds(spark, f"file://{tmp_path}", splits=("train", "val"), names=("b", "c")).collect()} == {"b", "c"}
    assert {r.cloud for r in readers.array_clouds(spark, f"file://{tmp_path}/val").collect()} == {"c"}


def test_part_clouds_and_lists(spark, tmp_path):
    from nubila.sources import readers

    (tmp_path / "synsetoffset2category.txt").write_text("Plane\t001\nBag\t002\n")
    for folder, cloud in (("001", "p1"), ("001", "p2"), ("002", "b1"), ("003", "x")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{cloud}.txt").write_text("0.5 1 2 0 0 1 3.0\n1 2 3 1 0 0 4.0\n")
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "train.json").write_text('["shape_data/001/p1"]')
    (lists / "test.json").write_text('["shape_data/001/p2", "shape_data/002/b1", "shape_data/002/none"]')
    clouds = readers.part_clouds(spark, f"file://{tmp_path}")
    got = sorted((r.category, r["class"], r.cloud, r.row, r.x, r.nz, r.part) for r in clouds.collect())
    assert got == sorted((c, k, n, i, *v) for c, k, n in (("Plane", 0, "p1"), ("Plane", 0, "p2"), ("Bag", 1, "b1")) for i, v in enumerate([(0.5, 1.0, 3), (1.0, 0.0, 4)]))
    split = readers.listed(spark, clouds, {"train": f"file://{lists}/train.json", "test": f"file://{lists}/test.json"})
    assert {(r.cloud, r.split) for r in split.collect()} == {("p1", "train"), ("p2", "test"), ("b1", "test")}


def test_summaries_of_parts_rooms_and_merges(spark):
    from nubila.operators import cells, metrics

    shapes = spark.createDataFrame([(1, "a", 0.5), (2, "a", 1.0), (3, "b", 0.25)], "shape int, category string, iou double")
    got = {r.category: r for r in metrics.part_iou_summary(shapes).collect()}
    assert got["a"].iou == 0.75 and got["b"].shapes == 1 and abs(got[None].iou - 1.75 / 3) < 1e-12 and got[None].class_iou == 0.5
    rooms = spark.createDataFrame([("x", 10, 2.0, 3), ("y", 30, 4.0, 5)], "batch string, points long, mean double, maximum long")
    r = cells.mean_over_groups(rooms).collect()[0]
    assert (r.groups, r.points, r.mean, r.maximum) == (2, 40, 3.0, 4.0)
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    with pytest.raises(ValueError, match="several"):
        records.merged(a, a.limit(0), ("k",))


def test_sweep_chain_derives_its_frames_once(spark, monkeypatch):
    """One row per frame until sweeps meet their poses: no table of steps, and the frames are read once."""
    monkeypatch.setattr(poses, "ancestors", None)
    seen = spark.sparkContext.accumulator(0)

    def counted(i):
        seen.add(1)
        return (i, i - 1 if i % 50 else None, 10 * i, [float(i), 0.0, 0.0], [1.0, 0.0, 0.0, 0.0])

    df = spark.sparkContext.parallelize(range(200), 3).map(counted).toDF("token long, prev long, ts long, t array<double>, q array<double>")
    frames = df.select("token", "prev", "ts", poses.matrix(F.col("t"), F.col("q")).alias("car_pose"), poses.matrix(F.col("t"), F.col("q")).alias("sensor_pose"))
    got = {(r.token, r.step): (r.sweep, r.lag, r.transform and r.transform[3]) for r in poses.sweep_chain(frames, 7).collect()}
    want = {}
    for i in range(200):
        for step in range(1, 7):
            back = min(step, i % 50)
            want[i, step] = (i - back, 10 * back, -2.0 * back if back else None)
    assert got == want
    assert seen.value == 200


@pytest.mark.parametrize("most", (1, 2, 5, 9))
def test_paths_stop_after_the_most_steps(spark, most):
    links = spark.createDataFrame([(i, i - 1 if i % 7 else None) for i in range(30)], "token long, prev long")
    got = {r.token: list(r.path) for r in poses.paths(links, most).collect()}
    assert got == {i: [i - s for s in range(1, min(most, i % 7) + 1)] for i in range(30) if i % 7}


def test_color_jitter_reads_its_clouds_twice(spark):
    """Once for the means, once for the result; not once more for each place in the order."""
    seen = spark.sparkContext.accumulator(0)

    def counted(i):
        seen.add(1)
        return (i, i % 8, float((37 * i) % 256), float((91 * i + 40) % 256), float((11 * i + 200) % 256))

    df = spark.sparkContext.parallelize(range(320), 3).map(counted).toDF("point_id long, batch int, r double, g double, b double")
    assert len(transforms.random_color_jitter(df, 0.3, 0.3, 0.3, 0.1, seed=2).collect()) == 320
    assert seen.value == 2 * 320


@pytest.mark.parametrize("most", (2, 4, 10))
def test_sweep_rows_are_those_along_links(spark, monkeypatch, most):
    """A chain of several stretches, short ones, frames alone, a chain without a name; nulls in poses."""
    monkeypatch.setattr(poses, "STRETCH", 8)
    monkeypatch.setattr(poses, "AT_ONCE", 40)
    rng = random.Random(most)
    unit = lambda: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([rng.gauss(0, 1) for _ in range(4)])
    chains = {"long": 400, "one": 1, "two": 2, None: 5, "ten": 10} | {f"c{i}": 1 + i % 4 for i in range(20)}
    rows, prev = [], {}
    for chain, n in chains.items():
        for i in range(n):
            token = f"{chain}-{i}"
            prev[token] = f"{chain}-{i - 1}" if i else None
            rows.append((chain, 10 * i + rng.randrange(10), token, prev[token], [rng.uniform(-5, 5) for _ in range(3)], unit(), [rng.uniform(-1, 1) for _ in range(3)], unit()))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "chain string, ts long, token string, prev string, ct array<double>, cq array<double>, st array<double>, sq array<double>").repartition(3)
    posed = lambda d: d.withColumns({"car_pose": poses.matrix(F.col("ct"), F.col("cq")), "sensor_pose": poses.matrix(F.col("st"), F.col("sq"))})
    want = {(r.token, r.step): r for r in poses.sweep_chain(posed(df), most).collect()}
    out = poses.sweep_rows(df.drop("prev"), most, ("chain",), ("ts",), posed)
    got = out.collect()
    assert len(got) == len(want) == len(rows) * (most - 1)
    for r in got:
        w = want[r.token, r.step]
        assert (r.sweep, r.lag) == (w.sweep, w.lag) and (r.transform is None) == (w.transform is None)
        assert r.transform is None or np.allclose(r.transform, w.transform)
    # nulls make those cells null that come of them, also in products with 0, as in SQL
    holes = lambda d: posed(d).withColumn("car_pose", F.when(F.col("token") == "ten-3", F.lit(None)).when(F.col("token") == "ten-6", F.array(*[F.lit(None) if i == 3 else F.get("car_pose", F.lit(i)) for i in range(16)])).otherwise(F.col("car_pose")))
    for r in poses.sweep_rows(df.drop("prev"), most, ("chain",), ("ts",), holes).where("token like 'ten-%' and transform is not null").collect():
        empty = [v is None for v in r.transform]
        if {"ten-3", "ten-6"} & {r.token, r.sweep}:
            assert all(empty)
        else:
            assert not any(empty) and np.allclose(r.transform, want[r.token, r.step].transform)


def test_sweep_chain_shuffles_events_not_poses(spark):
    from nubila.plans import catalog

    plan = catalog.queries()["sweep_chain"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan =="):]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "array" not in below
