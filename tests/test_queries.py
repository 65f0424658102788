"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from nubila.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, got):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in got)


CHEAP = ("morton_encode", "voxel_counts", "cell_neighbors", "knn_exact", "knn_grid", "knn_padded_self", "ball_even", "octree_select", "knn_adaptive", "components", "kfold_rollup", "bench_pivot", "bench_ci", "serialized_pool", "grid_sample_parts", "lovasz",
         "multiset_common", "key_differences", "required_methods", "identity_mismatches", "cyclic_order", "candidate_distribution", "candidate_bands", "serialized_order", "grid_sample_member", "ball_padded_first", "ball_padded_minus_one", "radius_l1", "interp_gaussian", "group_all", "pooled_recall", "boundary_histogram",
         "instance_ap", "octree_nodes", "sweep_chain", "ivf_calibration", "color_jitter_order", "soft_dilation", "serialization_z", "hilbert_order", "hilbert_decode", "elastic_distortion", "cluster_ids", "member_crop", "room_augmentation", "attn_head_bias")


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_speedups_at_halves_match_sql(spark, tmp_path):
    """Ratios that end in a half at the last digit: rounded by the scaled double, times added in the order of their ids."""
    times = [((53.68,), 51.2), ((128.45,), 32.0), ((26.74,), 12.8), ((183.65, 49.65, 7.15), 32.0), ((138.85, 121.81, 67.45), 6.4), ((153.39, 106.91, 53.56), 64.0), ((60.84, 68.51, 144.43), 64.0)]
    rows = [(6 * (10 * user + i), user, "click", v) for user, (base, _) in enumerate(times) for i, v in enumerate(base)]
    rows += [(6 * (10 * user + 9), user, "view", v) for user, (_, v) in enumerate(times)]
    events = spark.createDataFrame(sorted(rows), "event_id long, user_id long, event_type string, value double")
    con = duckdb.connect(config={"threads": 1})
    events.coalesce(1).write.parquet(f"{tmp_path}/sorted")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/sorted/*.parquet'")
    # the same rows in another order
    events.coalesce(1).sortWithinPartitions("event_type", -events.event_id).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["bench_speedup"](spark, str(tmp_path))
    want = con.sql(catalog.oracle_sql()["bench_speedup"])
    exact = lambda found: sorted((r[0], r[3], r[4], r[5]) for r in found if r[5] is not None)
    assert got.columns == want.columns and exact(got.collect()) == exact(want.fetchall())
    assert len(exact(got.collect())) == 2 * len(times)


def test_sweep_chain_on_odd_rows_matches_sql(spark, tmp_path):
    """Events without a value or user, users with one event, one with more than a stretch."""
    from datetime import datetime, timedelta

    users = [0] * 2500 + [None] * 7 + [1] + [2] * 2 + [3] * 40
    events = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * ((i * 389) % 5003)), u, None if i % 13 == 5 else round((i * 37 % 1009) / 7, 2)) for i, u in enumerate(users)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.queries()["sweep_chain"](spark, str(tmp_path))
    want = con.sql(catalog.oracle_sql()["sweep_chain"])
    assert got.columns == want.columns
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
