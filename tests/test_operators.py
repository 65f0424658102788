"""Operators on hand-made tables: padding, ties, batches, faces, negative cells, radius edges, empty clouds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubila.functions import keys, transforms
from nubila.operators import ball, cells, cluster, knn, metrics, neighbors, pooling, records, sampling
from nubila.schema import checked_grid, require
from nubila.sources import readers, sinks
from nubila.streaming.frames import each_frame

POINT = "point_id long, batch int, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(i, b, float(x), float(y), float(z)) for i, b, x, y, z in rows], POINT)


@pytest.fixture(scope="module")
def random_cloud(spark):
    rng = np.random.default_rng(5)
    xyz = rng.normal(size=(120, 3))
    return cloud(spark, [(i, i % 2, *p) for i, p in enumerate(xyz)])


def brute(points, k):
    rows = [tuple(r) for r in points.collect()]
    out = set()
    for q in rows:
        d = sorted(((q[2] - s[2]) ** 2 + (q[3] - s[3]) ** 2 + (q[4] - s[4]) ** 2, s[0]) for s in rows if s[1] == q[1])
        out |= {(q[0], r + 1, s) for r, (_, s) in enumerate(d[:k])}
    return out


def test_exact_knn_matches_brute_force(random_cloud):
    got = {(r.query_id, r.rank, r.support_id) for r in knn.knn_exact(random_cloud, 5).collect()}
    assert got == brute(random_cloud, 5)
    assert {r.round for r in knn.knn_exact(random_cloud, 5, rounds=True).select("round").distinct().collect()} != {1}


def test_empty_cloud(spark):
    empty = cloud(spark, [])
    for out in (knn.knn_exact(empty, 3), knn.knn_grid(empty, 3, 0.1), ball.hits(empty, 1.0), cells.voxel_first(empty, 0.1), cluster.components(spark.range(0).selectExpr("id as node"), spark.range(0).selectExpr("id as a", "id as b"))):
        assert out.collect() == []


def test_single_point_is_padded(spark):
    one = cloud(spark, [(7, 0, 0, 0, 0)])
    found = knn.knn_grid(one, 3, 0.1)
    for pad, ids in (("self", [7, 7, 7]), ("minus_one", [7, -1, -1]), ("nearest", [7, 7, 7]), ("none", [7])):
        got = sorted((r.rank, r.support_id, r.is_padding) for r in knn.padded(found, one, 3, pad).collect())
        assert [g[1] for g in got] == ids and not got[0][2] and all(g[2] for g in got[1:])
    with pytest.raises(ValueError):
        knn.padded(found, one, 3, "zero")


def test_duplicates_are_ordered_by_id_and_batches_stay_apart(spark):
    p = cloud(spark, [(i, b, 1, 1, 1) for i, b in ((3, 0), (1, 0), (2, 1), (4, 1))])
    got = sorted((r.query_id, r.rank, r.support_id) for r in knn.knn_exact(p, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 3), (2, 1, 2), (2, 2, 4), (3, 1, 1), (3, 2, 3), (4, 1, 2), (4, 2, 4)]


def test_neighbour_two_cells_away_is_found_by_exact_search_only(spark):
    p = cloud(spark, [(1, 0, 0.05, 0, 0), (2, 0, 0.95, 0, 0)])
    assert {r.support_id for r in knn.knn_grid(p, 2, 0.1, num_down=2).where("query_id = 1").collect()} == {1}
    assert {r.support_id for r in knn.knn_exact(p, 2).where("query_id = 1").collect()} == {1, 2}


def test_faces_and_negative_coordinates(spark):
    p = cloud(spark, [(1, 0, 0.39, 0, 0), (2, 0, -0.01, 0, 0), (3, 0, -0.41, 0, 0)])
    a = {(r.query_id, r.support_id) for r in knn.knn_grid(p, 3, 0.1).collect()}
    assert (1, 2) in a and (2, 3) in a and (1, 3) not in a
    assert [r.gx for r in cells.with_cells(p, 0.4).orderBy("point_id").collect()] == [0, -1, -2]


def test_span_is_checked(spark):
    p = cells.with_cells(cloud(spark, [(1, 0, 0, 0, 0), (2, 0, 70000, 0, 0)]), 1.0)
    with pytest.raises(Exception, match="outside"):
        checked_grid(p).collect()
    with pytest.raises(ValueError):
        require(p, "colour")


def test_radius_edges_and_even_ranks(spark):
    p = cloud(spark, [(i, 0, i * 0.5, 0, 0) for i in range(5)])
    near = {(r.query_id, r.support_id) for r in ball.hits(p, 0.5).collect()}
    assert near == {(i, i) for i in range(5)}  # strictly below the radius
    shell = {(r.query_id, r.support_id) for r in ball.hits(p, 1.1, min_radius=0.6).where("query_id = 2").collect()}
    assert shell == {(2, 2), (2, 0), (2, 4)}  # the point itself is always in
    all5 = ball.ball_query(p, 9.0, 2, mode="even").where("query_id = 0").orderBy("rank").collect()
    assert [(r.rank, r.support_id) for r in all5] == [(1, 0), (2, 2)]
    assert ball.ball_query(p, 9.0, 10, mode="even").where("query_id = 0").count() == 5


def test_keys_round_trip_and_hilbert_steps(spark):
    g = spark.range(512).selectExpr("id % 8 as gx", "(id div 8) % 8 as gy", "id div 64 as gz", "cast(0 as int) as batch")
    back = g.select("gx", "gy", "gz", keys.morton(F.col("gx"), F.col("gy"), F.col("gz"), F.lit(3)).alias("key"))
    d = keys.morton_decode(F.col("key"))
    assert back.where((d["gx"] != F.col("gx")) | (d["gy"] != F.col("gy")) | (d["gz"] != F.col("gz")) | (d["batch"] != 3)).count() == 0
    for order in ("hilbert", "hilbert-trans"):
        rows = keys.serialized(g, order, 3).orderBy("code").collect()
        assert [r.code for r in rows] == list(range(512))
        assert all(abs(a.gx - b.gx) + abs(a.gy - b.gy) + abs(a.gz - b.gz) == 1 for a, b in zip(rows, rows[1:]))
    with pytest.raises(ValueError):
        keys.serialized(g, "peano", 3)


def test_iou_variants_differ_for_an_absent_class(spark):
    seg = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "target int, pred int")
    areas = metrics.class_areas(metrics.confusion(seg, 3))
    value = {m: [r.iou for r in metrics.iou(areas, m).orderBy("class").collect()] for m in ("nan", "eps", "clamp")}
    assert value["nan"][2] is None and value["eps"][2] == 0 and value["clamp"][2] == 0
    assert value["nan"][:2] == [0.5, 0.5]


def test_components_do_not_join_over_another_label(spark):
    p = cloud(spark, [(i, 0, i * 0.1, 0, 0) for i in range(7)]).withColumn("label", F.when(F.col("point_id") == 3, 1).otherwise(0))
    got = {r.point_id: r.cluster for r in cluster.label_clusters(p, 0.15).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4}
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in cluster.components(spark.range(201).selectExpr("id as node"), chain).collect()} == {0}


def test_farthest_points_and_crops(spark, random_cloud):
    got = sampling.farthest_points(random_cloud, 4).collect()
    for b in (0, 1):
        mine = {r.point_id: np.array(r[2:]) for r in random_cloud.where(f"batch = {b}").collect()}
        taken = [r.point_id for r in sorted(got, key=lambda r: r.step) if r.batch == b]
        want = [min(mine)]
        while len(want) < 4:
            want.append(max(sorted(mine), key=lambda i: min(((mine[i] - mine[j]) ** 2).sum() for j in want)))
        assert taken == want
    crops = sampling.crops_until_covered(random_cloud, 25)
    assert crops.select("point_id").distinct().count() == 120 and crops.groupBy("batch", "crop").count().where("count <> 25").count() == 0


def test_ivf_recall_grows_with_probes(random_cloud):
    exact = knn.knn_exact(random_cloud, 4)
    recall = [metrics.recall_summary(metrics.set_recall(exact, knn.knn_ivf(random_cloud, 4, lists=8, probe=p))).first().mean for p in (1, 8)]
    assert recall[0] < recall[1] == 1


def test_average_precision(spark):
    rows = [(1, 0.5, 10, 1, 0.9, 0.8, 2), (1, 0.5, 11, 1, 0.7, 0.6, 2), (1, 0.5, 12, 2, 0.6, 0.5, 2)]
    got = metrics.average_precision(spark.createDataFrame(rows, "class int, threshold double, pred_id int, gt_id int, iou double, score double, n_gt int")).first()
    assert abs(got.ap - (0.5 + 0.5 * 2 / 3)) < 1e-9


def test_speedups_of_zero_times(spark):
    rows = [("r", "pre", 8, "base", 2.0), ("r", "pre", 8, "a", 0.0), ("r", "pre", 8, "b", 4.0), ("s", "pre", 8, "base", 0.0), ("s", "pre", 8, "a", 0.0), ("t", "pre", 8, "a", 0.0)]
    df = spark.createDataFrame(rows, "room string, mode string, k int, method string, query_ms double")
    got = {(r.room, r.method): str(r.speedup) for r in records.speedups(df, "base").collect()}
    assert got == {("r", "base"): "1.0", ("r", "a"): "inf", ("r", "b"): "0.5", ("s", "base"): "nan", ("s", "a"): "nan", ("t", "a"): "None"}


def test_records(spark):
    assert abs(records.t_quantile(10) - 2.228139) < 1e-5
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert records.merged(old, spark.createDataFrame([(2, 2.0), (3, 3.0)], "k int, v double"), ("k",)).count() == 3
    with pytest.raises(ValueError):
        records.merged(old, spark.createDataFrame([(2, 5.0)], "k int, v double"), ("k",))
    assert sinks.replaced(old, spark.createDataFrame([(2, 5.0)], "k int, v double"), ("k",)).where("v = 5").count() == 1
    assert "| 1 | 1.0 |" in sinks.markdown(old)


def test_relative_position_terms_and_softmax(spark):
    edges = spark.createDataFrame([(1, 5, 0, 2), (1, 5, 1, 3)], "query_id int, support_id int, axis int, rel_index int")
    table = spark.createDataFrame([(0, 2, 0, 1.0), (0, 2, 1, 2.0), (1, 3, 0, 3.0), (1, 3, 1, 4.0)], "axis int, rel_index int, c int, value double")
    feats = spark.createDataFrame([(1, 0, 10.0), (1, 1, 1.0)], "query_id int, c int, value double")
    assert neighbors.relative_position_terms(edges, table, feats).first().bias == 46.0


def test_transforms(spark, random_cloud):
    config = [{"type": "center_shift"}, {"type": "random_rotate", "seed": 3}, {"type": "random_scale", "seed": 3}, {"type": "random_flip"}, {"type": "random_jitter", "seed": 1}, {"type": "add", "split": "train"}]
    a, b = (sorted(map(tuple, transforms.Compose(config)(random_cloud).collect())) for _ in range(2))
    assert a == b and len(a) == 120
    with pytest.raises(ValueError):
        transforms.Compose([{"type": "no_such"}])
    views = transforms.contrastive_views(random_cloud, [{"type": "positive_shift"}], [{"type": "rotate", "angle": 1.0}])
    assert views.count() == 120 and "view2_x" in views.columns


def test_offsets(spark, random_cloud):
    off = pooling.batch_offsets(random_cloud)
    assert [(r.batch, r.offset) for r in off.orderBy("batch").collect()] == [(0, 60), (1, 120)]
    assert pooling.offsets_to_batch(off).where("batch = 1").agg(F.min("row"), F.max("row")).first()[:] == (60, 119)


def test_lidar_readers(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "l").mkdir()
    pts = np.arange(12, dtype="<f4").reshape(3, 4)
    pts.tofile(tmp_path / "v/000001.bin")
    np.array([10, 65536 + 40, 99], dtype="<i4").tofile(tmp_path / "l/000001.label")
    got = readers.lidar_xyzi(spark, f"{tmp_path}/v", f"{tmp_path}/l", {10: 0, 40: 1}).orderBy("row").collect()
    assert [(r.frame, r.x, r.strength, r.segment) for r in got] == [("000001", 0.0, 3.0, 0), ("000001", 4.0, 7.0, 1), ("000001", 8.0, 11.0, -1)]
    assert readers.lidar_pairs(spark, f"{tmp_path}/v").where("segment = -1").count() == 3


def test_text_readers_sweeps_and_meshes(spark, tmp_path):
    room = tmp_path / "office_1/Annotations"
    room.mkdir(parents=True)
    (room / "chair_1.txt").write_text("1 2 3 4 5 6\n7 8 9 1 1 1\n")
    (room / "sofa_2.txt").write_text("0 0 0 0 0 0\n")
    got = {(r.room, r.segment, r.instance, r.x) for r in readers.annotated_text(spark, str(tmp_path), ("chair", "clutter")).collect()}
    assert got == {("office_1", 0, 0, 1.0), ("office_1", 0, 0, 7.0), ("office_1", 1, 1, 0.0)}
    frames = spark.createDataFrame([("a", i, float(i)) for i in range(3)], "scene string, frame int, ts double")
    last = {(r.step, r.sweep, r.lag) for r in readers.sweeps(frames, 4).where("frame = 2").collect()}
    assert last == {(1, 1, 1.0), (2, 0, 2.0), (3, 0, 2.0)}
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vertex int, x double, y double, z double")
    n = readers.mesh_normals(v, spark.createDataFrame([(0, 0, 1, 2)], "face int, a int, b int, c int")).collect()
    assert len(n) == 3 and all((r.nx, r.ny, r.nz) == (0.0, 0.0, 1.0) for r in n)
    mixed = readers.interleaved([spark.range(4).toDF("v"), spark.range(10, 12).toDF("v")], [2, 1], "v").orderBy("turn", "source", "at").collect()
    assert [r.v for r in mixed] == [0, 1, 10, 2, 3, 11]
    assert readers.looped([spark.range(2).toDF("v"), spark.range(1).toDF("w")], 3).count() == 9


def test_sinks_and_frames(spark, tmp_path, random_cloud):
    sinks.upsert(random_cloud.where("point_id < 10"), f"{tmp_path}/t", ("point_id",))
    sinks.upsert(random_cloud.where("point_id < 20"), f"{tmp_path}/t", ("point_id",))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 20
    sinks.ply_points(random_cloud, f"{tmp_path}/ply")
    assert spark.read.text(f"{tmp_path}/ply/body").count() == 120
    stream = spark.readStream.schema(random_cloud.schema).parquet(f"{tmp_path}/t")
    q = each_frame(stream, lambda df: knn.knn_grid(df, 2, 1.0), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("query_id").distinct().count() == 20
