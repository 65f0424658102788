"""Named queries over the shared tables and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, transforms
from ..operators import ball, cells, cluster, knn, metrics, neighbors, pooling, records, sampling, windows
from ..sources.fixtures import bench_records, embedding_points, event_points, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

VOXEL, SHIFT, K, EVT = 0.05, 1.0, 8, 0.5

EMB = "emb AS (SELECT vec_id AS point_id, 0 AS batch, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label, embedding[4]::DOUBLE AS f0, embedding[5]::DOUBLE AS f1 FROM embeddings)"
EVENTS = """evt AS (SELECT event_id AS point_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS batch,
 value / 10 AS x, (hour(ts) + minute(ts) / 60)::DOUBLE AS y, (day(ts) - 1)::DOUBLE AS z FROM events)"""
REC = """rec AS (SELECT event_id, user_id AS room, event_type AS method, CASE WHEN event_id % 2 = 0 THEN 'pre' ELSE 'post' END AS mode,
 [8, 16, 24, 32, 48, 64][event_id % 6 + 1] AS k, value / 4 AS construction_ms, value AS query_ms FROM events)"""
D2 = "(q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z)"


def cells_sql(name: str, source: str, size: float, shift: float = 0.0, down: int = 0) -> str:
    return f"{name} AS (SELECT *, " + ", ".join(f"floor(({a} + {shift}) / {size})::BIGINT AS g{a}, floor(({a} + {shift}) / {size})::BIGINT >> {down} AS p{a}" for a in "xyz") + f" FROM {source})"


def near_sql(name: str, q: str, s: str, where: str = "") -> str:
    """All pairs within 27 cells."""
    return f"{name} AS (SELECT q.point_id AS query_id, s.point_id AS support_id, {D2} AS d2, q.batch AS batch FROM {q} q JOIN {s} s ON q.batch = s.batch AND abs(q.px-s.px) <= 1 AND abs(q.py-s.py) <= 1 AND abs(q.pz-s.pz) <= 1 {where})"


def top_sql(name: str, pairs: str, k: int) -> str:
    return f"{name} AS (SELECT query_id, rank, support_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, support_id) AS rank FROM {pairs}) WHERE rank <= {k})"


EXACT_PAIRS = f"pairs AS (SELECT q.point_id AS query_id, s.point_id AS support_id, {D2} AS d2 FROM emb q JOIN emb s ON q.batch = s.batch)"
EXACT = f"{EMB}, {EXACT_PAIRS}, {top_sql('nn', 'pairs', K)}"
GRID = f"{EMB}, {cells_sql('c', 'emb', VOXEL, SHIFT, 2)}, {near_sql('pairs', 'c', 'c')}, {top_sql('nn', 'pairs', K)}"


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _spread(e: str) -> str:
    e = f"(({e}) & 65535)"
    for by, mask in keys.SPREAD:
        e = f"(({e} | ({e} << {by})) & {mask})"
    return e


def _morton_steps(source: str, gx: str = "gx", gy: str = "gy", gz: str = "gz") -> str:
    """CTEs m0..m5 that spread three columns step by step; m5 has sx, sy, sz."""
    out = [f"m0 AS (SELECT *, {gx} & 65535 AS sx, {gy} & 65535 AS sy, {gz} & 65535 AS sz FROM {source})"]
    for i, (by, mask) in enumerate(keys.SPREAD):
        out.append(f"m{i + 1} AS (SELECT * REPLACE (" + ", ".join(f"((s{a} | (s{a} << {by})) & {mask}) AS s{a}" for a in "xyz") + f") FROM m{i})")
    return ", ".join(out)


# keys and cells


def _cells(spark, d):
    return cells.with_cells(event_points(spark, d), EVT)


EVT_CELLS = f"{EVENTS}, {cells_sql('c', 'evt', EVT)}"
COUNTS = f"{EVT_CELLS}, n AS (SELECT batch, gx, gy, gz, count(*) AS cnt FROM c GROUP BY ALL)"


@query(f"WITH {EVT_CELLS} SELECT point_id, batch, gx, gy, gz FROM c")
def grid_quantise(spark, d):
    return _cells(spark, d).select("point_id", "batch", "gx", "gy", "gz")


@query(f"WITH {EVT_CELLS}, {_morton_steps('c')} SELECT point_id, (batch::BIGINT << 48) | (sx << 2) | (sy << 1) | sz AS key FROM m5")
def morton_encode(spark, d):
    return _cells(spark, d).select("point_id", keys.morton(F.col("gx"), F.col("gy"), F.col("gz"), F.col("batch")).alias("key"))


@query(f"WITH {EVT_CELLS} SELECT point_id, gx, gy, gz, batch FROM c")
def morton_decode(spark, d):
    key = keys.morton(F.col("gx"), F.col("gy"), F.col("gz"), F.col("batch"))
    return _cells(spark, d).select("point_id", key.alias("key")).select("point_id", *[c.alias(n) for n, c in keys.morton_decode(F.col("key")).items()])


def _hilbert_steps(source: str, depth: int, x: str = "gx", y: str = "gy", name: str = "h") -> str:
    """CTEs that turn the cells of source to Hilbert keys, column hk of the last one, ``name``: one CTE for each bit and axis."""
    out, n = [f"{name}0 AS (SELECT *, {x} AS h0, {y} AS h1, gz AS h2 FROM {source})"], 0
    for b in range(depth - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(3):
            on, swap = f"h{i} & {bit} <> 0", f"(xor(h0, h{i}) & {low})"
            other = "" if i == 0 else f", CASE WHEN {on} THEN h{i} ELSE xor(h{i}, {swap}) END AS h{i}"
            out.append(f"{name}{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {on} THEN xor(h0, {low}) ELSE xor(h0, {swap}) END AS h0{other}) FROM {name}{n})")
            n += 1
    out.append(f"{name}g AS MATERIALIZED (SELECT * REPLACE (xor(h1, h0) AS h1, xor(h2, xor(h1, h0)) AS h2) FROM {name}{n})")
    flip = "0"
    for b in range(1, depth):
        flip = f"xor({flip}, h2 >> {b})"
    out.append(f"{name}f AS MATERIALIZED (SELECT *, {flip} AS flip FROM {name}g)")
    out.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (h0, h1, h2, flip), " + " | ".join(f"({_spread(f'xor(h{i}, flip)')} << {2 - i})" for i in range(3)) + f" AS hk FROM {name}f)")
    return ", ".join(out)


@query(f"WITH {EVT_CELLS}, {_hilbert_steps('c', 10)} SELECT point_id, batch, (batch::BIGINT << 30) | hk AS code FROM h")
def hilbert_order(spark, d):
    return keys.serialized(_cells(spark, d), "hilbert", 10).select("point_id", "batch", "code")


@query(f"WITH {EVT_CELLS} SELECT point_id, gx, gy, gz FROM c")
def hilbert_decode(spark, d):
    coded = keys.hilbert(_cells(spark, d), "gx", "gy", "gz", 10).select("point_id", "key")
    return keys.hilbert_decode(coded, "key", 10).select("point_id", "gx", "gy", "gz")


@query(f"WITH {EVT_CELLS}, {_morton_steps('c', 'gy', 'gx')} SELECT point_id, (batch::BIGINT << 48) | (sx << 2) | (sy << 1) | sz AS code FROM m5")
def serialize_z_trans(spark, d):
    return keys.serialized(_cells(spark, d), "z-trans", 16).select("point_id", "code")


@query(f"WITH {EVT_CELLS} SELECT batch, gx, gy, gz, min(point_id) AS point_id FROM c GROUP BY ALL")
def voxel_first(spark, d):
    return cells.voxel_first(event_points(spark, d), EVT).select("batch", "gx", "gy", "gz", "point_id")


@query(f"WITH {COUNTS}, {_morton_steps('n')}, k AS (SELECT *, (batch::BIGINT << 48) | (sx << 2) | (sy << 1) | sz AS key FROM m5) SELECT batch, gx, gy, gz, cnt, key, row_number() OVER w AS rank, (sum(cnt) OVER w - cnt)::BIGINT AS start FROM k WINDOW w AS (PARTITION BY batch ORDER BY key)")
def voxel_counts(spark, d):
    return cells.run_lengths(cells.voxel_counts(event_points(spark, d), EVT)).select("batch", "gx", "gy", "gz", "cnt", "key", "rank", "start")


@query("SELECT (l_suppkey % 8)::INT AS batch, floor(l_quantity::DOUBLE / 5)::BIGINT >> 1 AS px, floor(l_extendedprice::DOUBLE / 1000 / 5)::BIGINT >> 1 AS py, floor(l_discount::DOUBLE * 100 / 5)::BIGINT >> 1 AS pz, count(*) AS cnt FROM lineitem GROUP BY ALL")
def coarsen_cells(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).cast("int").alias("batch"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"), (F.col("l_discount").cast("double") * 100).alias("z"))
    return cells.coarsen(cells.with_cells(li, 5.0), 1).groupBy("batch", "px", "py", "pz").agg(F.count("*").alias("cnt"))


@query(f"WITH {COUNTS}, o AS (SELECT a, b, c, a*9+b*3+c AS nbr_pos, [0,-1,1][a+1] AS dx, [0,-1,1][b+1] AS dy, [0,-1,1][c+1] AS dz FROM range(3) t1(a), range(3) t2(b), range(3) t3(c)) SELECT n.batch, n.gx, n.gy, n.gz, o.nbr_pos::INT AS nbr_pos, m.cnt FROM n CROSS JOIN o JOIN n m ON m.batch = n.batch AND m.gx = n.gx + dx AND m.gy = n.gy + dy AND m.gz = n.gz + dz")
def cell_neighbors(spark, d):
    return cells.cell_neighbors(cells.voxel_counts(event_points(spark, d), EVT)).select("batch", "gx", "gy", "gz", "nbr_pos", "cnt")


@query(f"WITH {COUNTS} SELECT n.batch, n.gx, n.gy, n.gz, sum(m.cnt)::BIGINT AS candidates FROM n JOIN n m ON m.batch = n.batch AND abs(m.gx-n.gx) <= 1 AND abs(m.gy-n.gy) <= 1 AND abs(m.gz-n.gz) <= 1 GROUP BY ALL")
def candidate_counts(spark, d):
    return cells.candidate_counts(cells.voxel_counts(event_points(spark, d), EVT))


@query(f"WITH {EMB}, {cells_sql('c', 'emb', VOXEL, SHIFT, 1)}, {_morton_steps('c')}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, px, py, pz ORDER BY (sx << 2) | (sy << 1) | sz, point_id) AS rn, count(*) OVER (PARTITION BY batch, px, py, pz) AS cnt FROM m5) SELECT point_id, px, py, pz, cnt FROM r WHERE rn - 1 = cnt // 2")
def post_query_set(spark, d):
    return cells.representatives(embedding_points(spark, d), VOXEL, SHIFT).drop("batch")


# k nearest neighbours


@query(f"WITH {EXACT} SELECT * FROM nn")
def knn_exact(spark, d):
    return knn.knn_exact(embedding_points(spark, d), K)


BY_LABEL = EMB.replace("0 AS batch", "label AS batch")


@query(f"WITH {BY_LABEL}, {EXACT_PAIRS}, {top_sql('nn', 'pairs', 4)} SELECT * FROM nn")
def knn_exact_batched(spark, d):
    return knn.knn_exact(embedding_points(spark, d, batch_by_label=True), 4)


@query(f"WITH {EMB}, {EXACT_PAIRS}, {top_sql('nn', 'pairs', 3)} SELECT * FROM nn")
def three_nn(spark, d):
    return knn.knn_exact(embedding_points(spark, d), 3)


@query(f"WITH {EMB}, pairs AS (SELECT q.point_id AS query_id, s.point_id AS support_id, {D2} AS d2 FROM emb q JOIN emb s ON q.point_id % 3 = 0 AND s.point_id % 3 <> 0), {top_sql('nn', 'pairs', 1)} SELECT query_id, support_id, d2 FROM nn")
def closest_point(spark, d):
    p = embedding_points(spark, d)
    return knn.knn_exact(p.where("point_id % 3 <> 0"), 1, queries=p.where("point_id % 3 = 0")).drop("rank")


@query(f"WITH {EMB}, pairs AS (SELECT q.point_id AS query_id, s.point_id AS support_id, abs(q.x-s.x)+abs(q.y-s.y)+abs(q.z-s.z) AS d2 FROM emb q JOIN emb s ON q.batch = s.batch), {top_sql('nn', 'pairs', 5)} SELECT * FROM nn")
def knn_l1(spark, d):
    return knn.knn_exact(embedding_points(spark, d), 5, metric="l1")


def _grid(spark, d, **how):
    return knn.knn_grid(embedding_points(spark, d), K, VOXEL, shift=SHIFT, **how)


@query(f"WITH {GRID} SELECT * FROM nn")
def knn_grid(spark, d):
    return _grid(spark, d)


@query(f"WITH {EVENTS}, {cells_sql('c', 'evt', EVT, 0.0, 2)}, {near_sql('pairs', 'c', 'c')}, {top_sql('nn', 'pairs', K)} SELECT * FROM nn")
def knn_grid_events(spark, d):
    return knn.knn_grid(event_points(spark, d), K, EVT)


@query(f"WITH {EMB}, {cells_sql('c', 'emb', VOXEL, SHIFT, 2)}, {near_sql('pairs', 'c', 'c', f'WHERE {D2} < 0.0225')}, {top_sql('nn', 'pairs', K)} SELECT * FROM nn")
def knn_grid_cut(spark, d):
    return _grid(spark, d, cut_radius=0.15)


@query(f"WITH {EMB}, {cells_sql('c', 'emb', VOXEL, SHIFT, 2)}, sel AS (SELECT * FROM c WHERE point_id % 3 = 0), {near_sql('pairs', 'sel', 'c')}, {top_sql('nn', 'pairs', K)} SELECT * FROM nn")
def knn_selected(spark, d):
    return _grid(spark, d, queries=embedding_points(spark, d).where("point_id % 3 = 0"))


@query(f"WITH {EMB}, {cells_sql('c', 'emb', VOXEL, SHIFT, 2)}, cap AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY batch, gx, gy, gz ORDER BY point_id) <= 1), {near_sql('pairs', 'c', 'cap')}, {top_sql('nn', 'pairs', K)} SELECT * FROM nn")
def knn_voxel_cap(spark, d):
    return _grid(spark, d, cell_cap=1)


def _coarse(p):
    return cells.voxel_first(p, 0.1, SHIFT).select("point_id", "batch", "x", "y", "z")


BACK = f"{EMB}, {cells_sql('v', 'emb', 0.1, SHIFT)}, {cells_sql('c', 'emb', 0.2, SHIFT)}, co AS (SELECT c.* FROM c JOIN (SELECT min(point_id) AS point_id FROM v GROUP BY batch, gx, gy, gz) USING (point_id)), {near_sql('pairs', 'c', 'co')}"


@query(f"WITH {BACK}, {top_sql('nn', 'pairs', 1)} SELECT * FROM nn")
def knn_back1(spark, d):
    p = embedding_points(spark, d)
    return knn.knn_back(p, _coarse(p), 1, 0.2, SHIFT)


@query(f"WITH {BACK}, {top_sql('nn', 'pairs', 4)} SELECT * FROM nn")
def knn_backk(spark, d):
    p = embedding_points(spark, d)
    return knn.knn_back(p, _coarse(p), 4, 0.2, SHIFT)


PADS = f"slots AS (SELECT point_id AS query_id, r AS rank FROM emb CROSS JOIN range(1, {K + 1}) t(r))"


@query(f"WITH {GRID}, {PADS} SELECT query_id, rank, coalesce(support_id, query_id) AS support_id, coalesce(d2, 'inf'::DOUBLE) AS d2, support_id IS NULL AS is_padding FROM slots LEFT JOIN nn USING (query_id, rank)")
def knn_padded_self(spark, d):
    return knn.padded(_grid(spark, d), embedding_points(spark, d), K, "self")


@query(f"WITH {GRID}, {PADS} SELECT query_id, rank, coalesce(support_id, -1) AS support_id, coalesce(d2, 1e10) AS d2, support_id IS NULL AS is_padding FROM slots LEFT JOIN nn USING (query_id, rank)")
def knn_padded_minus1(spark, d):
    return knn.padded(_grid(spark, d), embedding_points(spark, d), K, "minus_one")


@query(f"WITH {GRID}, {PADS} SELECT query_id, rank, coalesce(support_id, first_value(support_id) OVER w) AS support_id, coalesce(d2, first_value(d2) OVER w) AS d2, support_id IS NULL AS is_padding FROM slots LEFT JOIN nn USING (query_id, rank) WINDOW w AS (PARTITION BY query_id ORDER BY rank)")
def knn_padded_nearest(spark, d):
    return knn.padded(_grid(spark, d), embedding_points(spark, d), K, "nearest")


@query()
def knn_ivf(spark, d):
    return knn.knn_ivf(embedding_points(spark, d), K)


LEVELS = 5
OCT = f"{EMB}, {cells_sql('c', 'emb', VOXEL, SHIFT)}, lv AS (SELECT l AS level, c.*, gx >> l AS lx, gy >> l AS ly, gz >> l AS lz FROM c CROSS JOIN range({LEVELS + 1}) t(l)), oc AS (SELECT level, batch, lx, ly, lz, count(*) AS cnt FROM lv GROUP BY ALL)"
OCT_CAND = f"{OCT}, cand AS (SELECT a.level, a.batch, a.lx, a.ly, a.lz, sum(b.cnt)::BIGINT AS n FROM oc a JOIN oc b ON a.level = b.level AND a.batch = b.batch AND abs(a.lx-b.lx) <= 1 AND abs(a.ly-b.ly) <= 1 AND abs(a.lz-b.lz) <= 1 GROUP BY ALL), per AS (SELECT point_id, batch, level, n FROM lv JOIN cand USING (level, batch, lx, ly, lz))"
# a level is reached if every coarser one has over 8k candidates and each level on the way down has 2k at least
OCT_SEL = f"{OCT_CAND}, chk AS (SELECT *, bool_and(n > {8 * K}) OVER (PARTITION BY point_id ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, bool_and(n >= {2 * K} OR level = {LEVELS}) OVER (PARTITION BY point_id ORDER BY level DESC) AS enough FROM per), sel AS (SELECT point_id, batch, min(level) AS level, arg_min(n, level) AS candidates FROM chk WHERE coalesce(above, true) AND enough GROUP BY ALL)"


@query(f"WITH {OCT} SELECT level::INT AS level, batch, lx AS gx, ly AS gy, lz AS gz, cnt FROM oc")
def octree_levels(spark, d):
    return cells.octree(embedding_points(spark, d), VOXEL, LEVELS, SHIFT)


@query(f"WITH {OCT_SEL} SELECT point_id, batch, level::INT AS level, candidates FROM sel")
def octree_select(spark, d):
    return cells.octree_select(embedding_points(spark, d), VOXEL, LEVELS, K, shift=SHIFT)


@query(f"WITH {OCT_SEL}, qs AS (SELECT lv.* FROM lv JOIN sel USING (point_id, level)), pairs AS (SELECT q.point_id AS query_id, s.point_id AS support_id, {D2} AS d2 FROM qs q JOIN lv s ON q.level = s.level AND q.batch = s.batch AND abs(q.lx-s.lx) <= 1 AND abs(q.ly-s.ly) <= 1 AND abs(q.lz-s.lz) <= 1), {top_sql('nn', 'pairs', K)} SELECT * FROM nn")
def knn_adaptive(spark, d):
    return knn.knn_adaptive(embedding_points(spark, d), K, VOXEL, LEVELS, shift=SHIFT)


# recall and coverage

BOTH = f"{EMB}, {EXACT_PAIRS.replace('pairs AS', 'ep AS')}, {top_sql('ex', 'ep', K)}, {cells_sql('c', 'emb', VOXEL, SHIFT, 2)}, {near_sql('pairs', 'c', 'c')}, {top_sql('nn', 'pairs', K)}"
RECALL = f"{BOTH}, rc AS (SELECT query_id, count(*) AS k, count(nn.support_id) AS hits, count(nn.support_id) / count(*) AS recall, 0::BIGINT AS repeated FROM ex LEFT JOIN nn USING (query_id, support_id) GROUP BY query_id)"


def _recalls(spark, d):
    return metrics.set_recall(knn.knn_exact(embedding_points(spark, d), K), _grid(spark, d))


@query(f"WITH {RECALL} SELECT * FROM rc")
def recall_set(spark, d):
    return _recalls(spark, d)


@query(f"WITH {RECALL} SELECT count(*) AS queries, avg(recall) AS mean, min(recall) AS minimum, quantile_cont(recall, 0.01) AS p01, quantile_cont(recall, 0.05) AS p05, 0::BIGINT AS duplicate_slots, 0::BIGINT AS duplicate_queries FROM rc")
def recall_summary(spark, d):
    return metrics.recall_summary(_recalls(spark, d))


R = 0.12
BALL = f"{EMB}, {cells_sql('c', 'emb', R, SHIFT)}, {near_sql('near', 'c', 'c')}, hit AS (SELECT * FROM near WHERE d2 < {R * R!r}), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support_id) - 1 AS rn, count(*) OVER (PARTITION BY query_id) AS cnt FROM hit)"


@query(f"WITH {BALL}, {EXACT_PAIRS}, {top_sql('nn', 'pairs', K + 1)}, f AS (SELECT query_id, count(*) AS n FROM b WHERE rn < {K} GROUP BY ALL), kd AS (SELECT query_id, max(d2) FILTER (rank = {K}) AS dk, max(d2) FILTER (rank = {K + 1}) AS dn FROM nn GROUP BY ALL) SELECT (sum(coalesce(n, 0)) / (count(*) * {K}))::DOUBLE AS valid, avg((dk >= {R * R!r})::INT) AS insufficient, avg((dn < {R * R!r})::INT) AS truncated FROM kd LEFT JOIN f USING (query_id)")
def coverage_ratios(spark, d):
    p = embedding_points(spark, d)
    return metrics.coverage(knn.knn_exact(p, K + 1), ball.ball_query(p, R, K, mode="first", shift=SHIFT), K, R)


@query(f"WITH {EXACT} SELECT quantile_cont(sqrt(d2), 0.9) AS radius FROM nn WHERE rank = {K}")
def radius_calibration(spark, d):
    return knn.knn_exact(embedding_points(spark, d), K).where(f"rank = {K}").agg(F.percentile(F.sqrt("d2"), F.lit(0.9)).alias("radius"))


# radius joins


@query(f"WITH {BALL}, e AS (SELECT *, CASE WHEN cnt <= 4 THEN rn ELSE (rn * 4 + cnt - 1) // cnt END AS i FROM b) SELECT query_id, i + 1 AS rank, support_id, d2 FROM e WHERE cnt <= 4 OR (i < 4 AND (cnt * i) // 4 = rn)")
def ball_even(spark, d):
    return ball.ball_query(embedding_points(spark, d), R, 4, mode="even", shift=SHIFT)


@query(f"WITH {BALL} SELECT query_id, rn + 1 AS rank, support_id, d2 FROM b WHERE rn < 4")
def ball_first(spark, d):
    return ball.ball_query(embedding_points(spark, d), R, 4, mode="first", shift=SHIFT)


@query(f"WITH {BALL}, r AS (SELECT query_id, support_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY (support_id * 1103515245 + 12345 + 7) % 2147483648, support_id) AS rank FROM hit) SELECT query_id, rank, support_id, d2 FROM r WHERE rank <= 4")
def ball_lcg_random(spark, d):
    return ball.ball_query(embedding_points(spark, d), R, 4, mode="random", seed=7, shift=SHIFT)


@query(f"WITH {BALL} SELECT query_id, support_id, d2 FROM hit")
def ball_all(spark, d):
    return ball.hits(embedding_points(spark, d), R, shift=SHIFT)


@query(f"WITH {BALL} SELECT query_id, support_id, d2 FROM near WHERE (d2 >= 0.0025 AND d2 < {R * R!r}) OR d2 <= 1e-5")
def ball_shell(spark, d):
    return ball.hits(embedding_points(spark, d), R, min_radius=0.05, shift=SHIFT)


@query(f"WITH {BALL}, {top_sql('nn', '(SELECT * FROM hit WHERE query_id % 2 = 0 AND support_id % 2 = 1)', 6)} SELECT query_id, arg_min(support_id, o) AS support_id, arg_min(d2, o) AS d2 FROM (SELECT *, ((support_id * 1103515245 + 12345) % 2147483648) AS o FROM nn) GROUP BY query_id")
def match_pairs(spark, d):
    p = embedding_points(spark, d)
    return ball.match_pairs(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), 6, R, SHIFT)


@query(f"WITH {BY_LABEL}, {cells_sql('v', 'emb', 0.05, SHIFT)}, k AS (SELECT v.* FROM v JOIN (SELECT min(point_id) AS point_id FROM v GROUP BY batch, gx, gy, gz) USING (point_id)), m AS (SELECT DISTINCT q.point_id, q.batch AS a, s.batch AS b FROM k q JOIN k s ON q.batch <> s.batch AND {D2} < {(1.5 * 0.05) * (1.5 * 0.05)!r}), sh AS (SELECT a, b, count(*) / any_value(t) AS share FROM m JOIN (SELECT batch, count(*) AS t FROM k GROUP BY batch) c ON c.batch = m.a GROUP BY a, b) SELECT least(a, b) AS cloud_a, greatest(a, b) AS cloud_b, max(share) AS overlap FROM sh GROUP BY ALL")
def overlap_pairs(spark, d):
    return ball.overlap(embedding_points(spark, d, batch_by_label=True), 0.05, shift=SHIFT)


# over neighbours

NB = f"{EXACT}, g AS (SELECT nn.*, s.x AS sx, s.y AS sy, s.z AS sz, s.f0 AS sf0, s.f1 AS sf1, s.label AS sl, q.x AS qx, q.y AS qy, q.z AS qz, q.f0 AS qf0, q.f1 AS qf1, q.label AS ql FROM nn JOIN emb s ON s.point_id = nn.support_id JOIN emb q ON q.point_id = nn.query_id)"
FEATURES = ("f0", "f1")


def _nn(spark, d, k=K):
    p = embedding_points(spark, d)
    return knn.knn_exact(p, k), p


@query(f"WITH {NB} SELECT query_id, rank, support_id, sx-qx AS dx, sy-qy AS dy, sz-qz AS dz, sf0 AS f0, sf1 AS f1 FROM g")
def group_relative(spark, d):
    return neighbors.group_relative(*_nn(spark, d), FEATURES)


@query(f"WITH {EXACT} SELECT query_id, (rank - 1) // 2 + 1 AS rank, support_id, d2 FROM nn WHERE (rank - 1) % 2 = 0")
def dilated_group(spark, d):
    return neighbors.dilated(_nn(spark, d)[0], 4, 1)


@query(f"WITH {NB} SELECT query_id, round(sum(1 / (sqrt(d2) + 1e-8) * sf0) / sum(1 / (sqrt(d2) + 1e-8)), 6) AS f0, round(sum(1 / (sqrt(d2) + 1e-8) * sf1) / sum(1 / (sqrt(d2) + 1e-8)), 6) AS f1 FROM g WHERE rank BETWEEN 2 AND 4 GROUP BY query_id")
def interp_idw(spark, d):
    nn, p = _nn(spark, d)
    return neighbors.interpolate(nn.where("rank between 2 and 4"), p, FEATURES).select("query_id", *[F.round(f, 6).alias(f) for f in FEATURES])


@query(f"WITH {NB} SELECT query_id, rank, qf0 - sf0 AS f0, qf1 - sf1 AS f1 FROM g")
def subtract_nbr(spark, d):
    return neighbors.subtract(*_nn(spark, d), FEATURES)


@query(f"WITH {NB} SELECT query_id, round(sum((sf0 + rank * 0.1) * (1 / (1 + rank))), 6) AS f0, round(sum((sf1 + rank * 0.1) * (1 / (1 + rank))), 6) AS f1 FROM g GROUP BY query_id")
def aggregate_nbr(spark, d):
    out = neighbors.aggregate(*_nn(spark, d), FEATURES, F.col("rank") * F.lit(0.1), F.lit(1.0) / (F.col("rank") + 1))
    return out.select("query_id", *[F.round(f, 6).alias(f) for f in FEATURES])


@query(f"WITH {NB} SELECT query_id, max(sf0) - max(qf0) AS f0, max(sf1) - max(qf1) AS f1 FROM g GROUP BY query_id")
def edge_max(spark, d):
    return neighbors.edge_max(*_nn(spark, d), FEATURES)


@query(f"WITH {NB} SELECT query_id, rank, support_id, qf0*sf0 + qf1*sf1 AS relation FROM g")
def attn_relation(spark, d):
    return neighbors.attention_relation(*_nn(spark, d), FEATURES)


SOFT = f"{NB}, rl AS (SELECT *, exp(qf0*sf0 + qf1*sf1 - max(qf0*sf0 + qf1*sf1) OVER (PARTITION BY query_id)) AS e FROM g), sw AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS weight FROM rl)"


@query(f"WITH {SOFT} SELECT query_id, rank, round(weight, 9) AS weight FROM sw")
def scatter_softmax(spark, d):
    rel = neighbors.attention_relation(*_nn(spark, d), FEATURES)
    return neighbors.scatter_softmax(rel, "relation").select("query_id", "rank", F.round("weight", 9).alias("weight"))


@query(f"WITH {SOFT} SELECT query_id, round(sum(weight * sf0), 6) AS f0, round(sum(weight * sf1), 6) AS f1 FROM sw GROUP BY query_id")
def attn_fusion(spark, d):
    nn, p = _nn(spark, d)
    w = neighbors.scatter_softmax(neighbors.attention_relation(nn, p, FEATURES), "relation")
    return neighbors.attention_fusion(w, p, "weight", FEATURES).select("query_id", *[F.round(f, 6).alias(f) for f in FEATURES])


# pooling and sampling


@query(f"WITH {EVT_CELLS} SELECT batch, gx, gy, gz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS cnt, dense_rank() OVER (PARTITION BY batch ORDER BY gx, gy, gz) AS cluster FROM c GROUP BY batch, gx, gy, gz")
def grid_pool(spark, d):
    out = pooling.grid_pool(event_points(spark, d), EVT)
    return out.select("batch", "gx", "gy", "gz", *[F.round(a, 6).alias(a) for a in "xyz"], "cnt", "cluster")


@query(f"WITH {EVT_CELLS}, p AS (SELECT batch, gx, gy, gz, max(x) AS mx, dense_rank() OVER (PARTITION BY batch ORDER BY gx, gy, gz) AS cluster FROM c GROUP BY batch, gx, gy, gz) SELECT point_id, batch, cluster, mx + c.x AS up_x FROM c JOIN p USING (batch, gx, gy, gz)")
def unpool_map(spark, d):
    p = event_points(spark, d).withColumn("v", F.col("x"))
    pooled = pooling.grid_pool(p, EVT, ("v",)).drop("x").withColumnRenamed("v", "x")
    return pooling.unpool(p, pooled, EVT, ("x",), add=("x",))


@query(f"WITH {EVT_CELLS}, {_morton_steps('c')}, k AS (SELECT *, (batch::BIGINT << 48) | (sx << 2) | (sy << 1) | sz AS code FROM m5) SELECT code >> 6 AS pool, arg_min(point_id, (code, point_id)) AS head, count(*) AS cnt, max(x) AS x FROM k GROUP BY 1")
def serialized_pool(spark, d):
    return pooling.serialized_pool(keys.serialized(_cells(spark, d), "z", 16), 2, ("x",))


@query(f"WITH {EVENTS} SELECT batch, count(*) AS cnt, (sum(count(*)) OVER (ORDER BY batch))::BIGINT AS \"offset\" FROM evt GROUP BY batch")
def batch_offsets(spark, d):
    return pooling.batch_offsets(event_points(spark, d))


@query(f"WITH {EVENTS} SELECT batch, row_number() OVER (ORDER BY batch, point_id) - 1 AS row FROM evt")
def offsets_to_batch(spark, d):
    return pooling.offsets_to_batch(pooling.batch_offsets(event_points(spark, d)))


@query(f"WITH {EVENTS} SELECT batch, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM evt GROUP BY batch")
def batch_mean_pool(spark, d):
    return pooling.batch_mean(event_points(spark, d), ("x", "y", "z")).select("batch", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(f"WITH {EVT_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, gx, gy, gz ORDER BY (point_id * 1103515245 + 12345 + 3) % 2147483648, point_id) AS rn, count(*) OVER (PARTITION BY batch, gx, gy, gz) AS cnt FROM c) SELECT batch, gx, gy, gz, point_id, cnt, round((x + 0.0) / {EVT} - gx - 0.5, 6) AS disp_x FROM r WHERE rn = 1")
def grid_sample_pick(spark, d):
    return sampling.grid_sample(event_points(spark, d), EVT, seed=3).select("batch", "gx", "gy", "gz", "point_id", "cnt", F.round("disp_x", 6).alias("disp_x"))


@query(f"WITH {EVT_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, gx, gy, gz ORDER BY point_id) - 1 AS rn, count(*) OVER (PARTITION BY batch, gx, gy, gz) AS cnt FROM c), m AS (SELECT batch, max(cnt) AS parts FROM r GROUP BY batch) SELECT point_id, r.batch, i AS part FROM r JOIN m USING (batch) JOIN range(1000) t(i) ON i < parts AND i % cnt = rn")
def grid_sample_parts(spark, d):
    return sampling.grid_sample_parts(event_points(spark, d), EVT)


@query(f"WITH {EVENTS}, r AS (SELECT point_id, batch, (x-5.0)*(x-5.0)+(y-12.0)*(y-12.0)+(z-3.0)*(z-3.0) AS d2 FROM evt) SELECT point_id, batch, d2, row_number() OVER (PARTITION BY batch ORDER BY d2, point_id) AS rank FROM r QUALIFY rank <= 100")
def sphere_crop(spark, d):
    return sampling.sphere_crop(event_points(spark, d), (5, 12, 3), 100).select("point_id", "batch", "d2", "rank")


@query(f"WITH {EVENTS}, r AS (SELECT point_id, batch, row_number() OVER (PARTITION BY batch ORDER BY point_id) - 1 AS rn, count(*) OVER (PARTITION BY batch) AS cnt FROM evt) SELECT DISTINCT point_id, batch FROM r JOIN range(11) t(i) ON rn = floor(i * (cnt - 1) / 10)")
def even_sample(spark, d):
    return sampling.even_sample(event_points(spark, d), 11).select("point_id", "batch")


@query(f"WITH {EVENTS}, r AS (SELECT point_id, batch, row_number() OVER (PARTITION BY batch ORDER BY (point_id * 1103515245 + 12345 + 5) % 2147483648, point_id) AS rn, count(*) OVER (PARTITION BY batch) AS cnt FROM evt) SELECT point_id, batch FROM r WHERE rn <= floor(cnt * 0.8)")
def random_dropout(spark, d):
    return sampling.dropout(event_points(spark, d), 0.8, seed=5).select("point_id", "batch")


@query()
def fps(spark, d):
    return sampling.farthest_points(embedding_points(spark, d, batch_by_label=True), 16)


@query()
def crops_until_covered(spark, d):
    return sampling.crops_until_covered(embedding_points(spark, d, batch_by_label=True), 20)


# clustering

EDGES = f"{EMB}, e AS (SELECT q.point_id AS a, s.point_id AS b FROM emb q JOIN emb s ON q.label = s.label AND q.point_id <> s.point_id AND {D2} < 0.0225)"


@query(f"WITH RECURSIVE {EDGES}, reach(a, b) AS (SELECT point_id, point_id FROM emb UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), cc AS (SELECT a AS point_id, min(b) AS cluster FROM reach GROUP BY a) SELECT point_id, cluster, count(*) OVER (PARTITION BY cluster) AS cnt FROM cc QUALIFY cnt >= 3")
def components(spark, d):
    return cluster.label_clusters(embedding_points(spark, d), 0.15, least=3, shift=SHIFT)


@query(f"WITH RECURSIVE {EDGES}, reach(a, b) AS (SELECT point_id, point_id FROM emb WHERE label <> 0 UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), cc AS (SELECT a AS point_id, min(b) AS cluster FROM reach GROUP BY a) SELECT cluster, min(label) AS label, count(*) AS cnt, round(avg(f0), 6) AS mean_score, max(f0) AS max_score FROM cc JOIN emb USING (point_id) GROUP BY cluster HAVING count(*) >= 3")
def proposals(spark, d):
    out = cluster.proposals(embedding_points(spark, d), 0.15, "f0", ignored=(0,), least=3, shift=SHIFT)
    return out.withColumn("mean_score", F.round("mean_score", 6))


def _hierarchy_sql() -> str:
    ctes, parts = [EMB], []
    previous = "emb"
    for level, voxel in enumerate((0.05, 0.1, 0.2)):
        ctes += [cells_sql(f"c{level}", previous, voxel, SHIFT), f"l{level} AS (SELECT point_id, batch, x, y, z FROM c{level} JOIN (SELECT min(point_id) AS point_id FROM c{level} GROUP BY batch, gx, gy, gz) USING (point_id))"]
        ctes += [cells_sql(f"s{level}", f"l{level}", voxel, SHIFT, 2), near_sql(f"p{level}", f"s{level}", f"s{level}"), top_sql(f"n{level}", f"p{level}", 4)]
        parts.append(f"SELECT {level} AS level, 'knn' AS kind, * FROM n{level}")
        if level:
            ctes += [cells_sql(f"u{level}", "l0", voxel * 2, SHIFT), cells_sql(f"w{level}", f"l{level}", voxel * 2, SHIFT), near_sql(f"q{level}", f"u{level}", f"w{level}"), top_sql(f"b{level}", f"q{level}", 1)]
            parts.append(f"SELECT {level}, 'back', * FROM b{level}")
        previous = f"l{level}"
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query(_hierarchy_sql())
def hierarchy(spark, d):
    return cluster.hierarchy(embedding_points(spark, d), (0.05, 0.1, 0.2), 4, shift=SHIFT)


# metrics

SEG = f"{EXACT}, seg AS (SELECT q.point_id, (q.point_id % 6)::INT AS fold, (q.point_id % 7)::INT AS shape, q.label AS target, s.label AS pred FROM nn JOIN emb q ON q.point_id = nn.query_id JOIN emb s ON s.point_id = nn.support_id WHERE rank = 2)"
AREAS = f"{SEG}, ar AS (SELECT class, count(*) FILTER (target = class AND pred = class) AS intersection, count(*) FILTER (target = class) AS target_area, count(*) FILTER (pred = class) AS pred_area, count(*) FILTER (target = class OR pred = class) AS \"union\" FROM seg CROSS JOIN range(12) t(class) GROUP BY class)"


def _seg(spark, d):
    nn, p = _nn(spark, d, 2)
    lab = p.select("point_id", "label")
    s = nn.where("rank = 2").join(lab.withColumnsRenamed({"point_id": "query_id", "label": "target"}), "query_id").join(lab.withColumnsRenamed({"point_id": "support_id", "label": "pred"}), "support_id")
    return s.select(F.col("query_id").alias("point_id"), (F.col("query_id") % 6).cast("int").alias("fold"), (F.col("query_id") % 7).cast("int").alias("shape"), "target", "pred")


@query(f"WITH {SEG} SELECT a::INT AS target, b::INT AS pred, count(seg.point_id) AS n FROM range(12) t1(a) CROSS JOIN range(12) t2(b) LEFT JOIN seg ON target = a AND pred = b GROUP BY a, b")
def confusion(spark, d):
    return metrics.confusion(_seg(spark, d), 12)


@query("SELECT quality::INT AS target, toxic::INT AS pred, count(*) AS n FROM labels GROUP BY ALL")
def confusion_labels(spark, d):
    return metrics.confusion(table(spark, d, "labels"), 2, "quality", "toxic").where("n > 0")


def _areas(spark, d):
    return metrics.class_areas(metrics.confusion(_seg(spark, d), 12))


@query(f"WITH {AREAS} SELECT class::INT AS class, intersection / nullif(\"union\", 0) AS iou, intersection / nullif(target_area, 0) AS accuracy FROM ar")
def iou_nan(spark, d):
    return metrics.iou(_areas(spark, d), "nan")


@query(f"WITH {AREAS} SELECT class::INT AS class, intersection / (\"union\" + 1e-10) AS iou, intersection / (target_area + 1e-10) AS accuracy FROM ar")
def iou_eps(spark, d):
    return metrics.iou(_areas(spark, d), "eps")


@query(f"WITH {AREAS} SELECT class::INT AS class, intersection / greatest(\"union\", 1) AS iou, intersection / greatest(target_area, 1) AS accuracy FROM ar")
def iou_clamp(spark, d):
    return metrics.iou(_areas(spark, d), "clamp")


@query(f"WITH {AREAS} SELECT avg(intersection / nullif(\"union\", 0)) AS miou, avg(intersection / nullif(target_area, 0)) AS macc, (sum(intersection) / sum(target_area))::DOUBLE AS overall FROM ar")
def mean_iou(spark, d):
    return metrics.mean_iou(_areas(spark, d))


@query(f"WITH {SEG}, e AS (SELECT fold, class, target, pred FROM seg CROSS JOIN range(10) t(class) WHERE target = class OR pred = class) SELECT fold, class::INT AS class, count(*) FILTER (target = class AND pred = class) AS intersection, count(*) AS \"union\", count(*) FILTER (target = class) AS target_area FROM e GROUP BY GROUPING SETS ((fold, class), (class))")
def kfold_rollup(spark, d):
    return metrics.fold_rollup(_seg(spark, d))


@query(f"WITH {NB} SELECT query_id AS point_id, avg((ql = sl)::INT) AS same, avg((ql = sl)::INT) < 0.5 AS is_boundary FROM g GROUP BY query_id")
def boundary_split(spark, d):
    return metrics.boundary(*_nn(spark, d))


@query(f"WITH {NB}, pr AS (SELECT query_id AS point_id, sl AS class, round(sum(0.125), 9) AS p FROM g GROUP BY ALL) SELECT point_id, arg_min(class, (-p, class)) AS pred, max(p) AS votes FROM pr GROUP BY point_id")
def vote_argmax(spark, d):
    nn, p = _nn(spark, d)
    return metrics.vote(neighbors.gathered(nn, p, ("label",)).select(F.col("query_id").alias("point_id"), F.col("n_label").alias("class"), F.lit(0.125).alias("prob")))


@query(f"WITH {SEG}, a AS (SELECT shape, class, count(*) FILTER (target = class AND pred = class) AS i, count(*) FILTER (target = class OR pred = class) AS u FROM seg CROSS JOIN range(12) t(class) GROUP BY ALL) SELECT shape, round(avg(CASE WHEN u = 0 THEN 1 ELSE i / u END), 9) AS iou FROM a GROUP BY shape")
def part_iou(spark, d):
    return metrics.part_iou(_seg(spark, d), 12).select("shape", F.round("iou", 9).alias("iou"))


@query(f"WITH {NB}, cl AS (SELECT unnest(range(10)) AS class), sh AS (SELECT query_id, class, ql, sum((sl = class)::INT) / {K}.0 AS prob FROM g CROSS JOIN cl GROUP BY ALL), er AS (SELECT class, query_id, (ql = class)::INT AS fg, abs((ql = class)::INT - prob) AS err FROM sh), w AS (SELECT *, sum(fg) OVER (PARTITION BY class) AS gt, sum(fg) OVER o AS cf, sum(1 - fg) OVER o AS cn FROM er WINDOW o AS (PARTITION BY class ORDER BY err DESC, query_id ROWS UNBOUNDED PRECEDING)), j AS (SELECT *, 1 - (gt - cf) / (gt + cn) AS j FROM w WHERE gt > 0), dj AS (SELECT class, err, j - coalesce(lag(j) OVER (PARTITION BY class ORDER BY err DESC, query_id), 0) AS dj FROM j) SELECT class::INT AS class, round(sum(err * dj), 6) AS loss FROM dj GROUP BY class")
def lovasz(spark, d):
    nn, p = _nn(spark, d)
    votes = neighbors.gathered(nn, p, ("label",)).select("query_id", "n_label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("class"))
    probs = votes.groupBy(F.col("query_id").alias("point_id"), "class").agg((F.sum(F.when(F.col("n_label") == F.col("class"), 1).otherwise(0)) / float(K)).alias("prob"))
    return metrics.lovasz(probs, p).select("class", F.round("loss", 6).alias("loss"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT label, 1 / (n / sum(n) OVER () + 0.02) AS w FROM c) SELECT label, round(w / avg(w) OVER (), 9) AS weight FROM w")
def class_weights(spark, d):
    return metrics.class_weights(table(spark, d, "embeddings")).select("label", F.round("weight", 9).alias("weight"))


# benchmark records


@query(f"WITH {REC} SELECT method, mode, k, count(*) AS n, round(avg(construction_ms), 6) AS mean_construction_ms, round(avg(query_ms), 6) AS mean_query_ms FROM rec GROUP BY method, mode, k")
def bench_main(spark, d):
    out = records.main_table(bench_records(spark, d), ("method", "mode", "k"), ("construction_ms", "query_ms"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_construction_ms", "mean_query_ms")})


MODES, KS = ("pre", "post"), (8, 16, 24, 32, 48, 64)
PIVOT = ", ".join(f"round(avg(value) FILTER (mode = '{m}' AND k = {k}), 6) AS {m}_{k}" for m in MODES for k in KS)


@query(f"WITH {REC}, l AS (SELECT method, mode, k, 'construction_ms' AS metric, construction_ms AS value FROM rec UNION ALL SELECT method, mode, k, 'query_ms', query_ms FROM rec) SELECT method, metric, {PIVOT} FROM l GROUP BY method, metric")
def bench_pivot(spark, d):
    out = records.pivot_table(bench_records(spark, d), ("method",), ("construction_ms", "query_ms"), MODES, KS)
    return out.select("method", "metric", *[F.round(f"{m}_{k}", 6).alias(f"{m}_{k}") for m in MODES for k in KS])


@query(f"WITH {REC}, m AS (SELECT room, mode, k, method, avg(query_ms) AS ms FROM rec GROUP BY ALL) SELECT m.room, m.mode, m.k, m.method, round(m.ms, 6) AS ms, round(b.ms / m.ms, 6) AS speedup FROM m LEFT JOIN m b ON b.method = 'click' AND m.room = b.room AND m.mode = b.mode AND m.k = b.k")
def bench_speedup(spark, d):
    return records.speedups(bench_records(spark, d), "click", order="event_id").withColumns({c: records.rounded(F.col(c), 6) for c in ("ms", "speedup")})


SIZES = "sz AS (SELECT user_id AS room, count(*) * 10000 AS num_support FROM events GROUP BY user_id)"


def _sizes(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("room")).agg((F.count("*") * 10000).alias("num_support"))


@query(f"WITH {REC}, {SIZES}, m AS (SELECT room, method, avg(query_ms) AS ms FROM rec GROUP BY ALL), e AS (SELECT m.method, m.ms, b.ms AS bms, num_support, CASE WHEN num_support <= 250000 THEN '<=250k' WHEN num_support <= 500000 THEN '250k-500k' WHEN num_support <= 1000000 THEN '500k-1M' WHEN num_support <= 2000000 THEN '1M-2M' ELSE '>2M' END AS bin FROM m JOIN m b ON b.room = m.room AND b.method = 'click' JOIN sz ON sz.room = m.room) SELECT bin, method, count(*) AS rooms, round(avg(ms), 6) AS mean_ms, round(avg(num_support / ms / 1000), 6) AS mquery_s, round(avg(bms / ms), 6) AS speedup FROM e GROUP BY ALL")
def bench_bins(spark, d):
    return records.binned(bench_records(spark, d), _sizes(spark, d), "click").withColumns({c: F.round(c, 6) for c in ("mean_ms", "mquery_s", "speedup")})


@query(f"WITH {REC} SELECT method, mode, count(*) AS n, round(avg(query_ms), 6) AS mean, round(stddev_samp(query_ms), 6) AS sd, round(quantile_cont(query_ms, 0.5), 6) AS median, round(quantile_cont(query_ms, 0.95), 6) AS p95, min(query_ms) AS low, max(query_ms) AS high, round((1.959963984540054 + (1.959963984540054^3 + 1.959963984540054) / 4 / (count(*) - 1) + (5 * 1.959963984540054^5 + 16 * 1.959963984540054^3 + 3 * 1.959963984540054) / 96 / (count(*) - 1)^2) * stddev_samp(query_ms) / sqrt(count(*)), 5) AS ci95 FROM rec GROUP BY method, mode")
def bench_ci(spark, d):
    out = records.statistics(bench_records(spark, d), ("method", "mode"), "query_ms")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "median", "p95")}).withColumn("ci95", F.round("ci95", 5))


@query(f"WITH {REC}, r AS (SELECT method, query_ms, row_number() OVER (PARTITION BY method ORDER BY query_ms) - 1 AS rn, count(*) OVER (PARTITION BY method) AS n FROM rec) SELECT method, query_ms AS p95 FROM r WHERE rn = round_even(0.95 * (n - 1), 0)")
def bench_nearest_rank(spark, d):
    return records.nearest_rank(bench_records(spark, d), ("method",), "query_ms")


@query(f"WITH {REC}, m AS (SELECT method, room, quantile_cont(query_ms, 0.5) AS m FROM rec GROUP BY ALL) SELECT method, quantile_cont(m, 0.5) AS median FROM m GROUP BY method")
def bench_median_of_medians(spark, d):
    return records.median_of_medians(bench_records(spark, d), ("method",), "query_ms")


@query(f"WITH {SIZES}, t AS (SELECT unnest([250000, 500000, 1000000]) AS target) SELECT target::INT AS target, arg_min(room, (abs(num_support - target), room)) AS room, arg_min(num_support, (abs(num_support - target), room)) AS num_support FROM sz CROSS JOIN t GROUP BY target")
def bench_nearest_size(spark, d):
    return records.nearest_sizes(_sizes(spark, d), (250_000, 500_000, 1_000_000))


@query(f"WITH {REC} SELECT room, event_id, query_ms AS latest, round(avg(query_ms) OVER w, 10) AS window_mean, round(quantile_cont(query_ms, 0.5) OVER w, 10) AS window_median, round(avg(query_ms) OVER g, 10) AS global_mean FROM rec WINDOW w AS (PARTITION BY room ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), g AS (PARTITION BY room ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def history_buffer(spark, d):
    out = records.moving(bench_records(spark, d), "query_ms", 5, "event_id", ("room",))
    return out.withColumns({c: F.round(c, 10) for c in ("window_mean", "window_median", "global_mean")})


@query(f"WITH {REC} SELECT * FROM rec WHERE event_id NOT IN (SELECT event_id FROM rec WHERE k = 8)")
def resume_remaining(spark, d):
    r = bench_records(spark, d)
    return records.remaining(r, r.where("k = 8"), ("event_id",))


@query(f"WITH {REC} SELECT * FROM rec WHERE k <> 64")
def merge_results(spark, d):
    r = bench_records(spark, d)
    return records.merged(r.where("k < 48"), r.where("k between 32 and 48"), ("event_id",))


# transforms

PERC = "PARTITION BY batch"


@query(f"WITH {EVENTS} SELECT point_id, x - min(x) OVER p AS x, y - min(y) OVER p AS y, z - min(z) OVER p AS z FROM evt WINDOW p AS ({PERC})")
def positive_shift(spark, d):
    return transforms.positive_shift(event_points(spark, d)).select("point_id", "x", "y", "z")


@query(f"WITH {EVENTS} SELECT point_id, x - (min(x) OVER p + max(x) OVER p) / 2 AS x, y - (min(y) OVER p + max(y) OVER p) / 2 AS y, z - min(z) OVER p AS z FROM evt WINDOW p AS ({PERC})")
def center_shift(spark, d):
    return transforms.center_shift(event_points(spark, d)).select("point_id", "x", "y", "z")


@query(f"WITH {EVENTS}, c AS (SELECT point_id, batch, x - avg(x) OVER p AS x, y - avg(y) OVER p AS y, z - avg(z) OVER p AS z FROM evt WINDOW p AS ({PERC})), m AS (SELECT *, max(sqrt(x*x+y*y+z*z)) OVER ({PERC}) AS m FROM c) SELECT point_id, round(x / m, 6) AS x, round(y / m, 6) AS y, round(z / m, 6) AS z FROM m")
def normalize_coord(spark, d):
    return transforms.normalize_coord(event_points(spark, d)).select("point_id", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(f"WITH {EVENTS} SELECT point_id, greatest(least(x, 30), 5) AS x, greatest(least(y, 20), 2) AS y, greatest(least(z, 20), 1) AS z FROM evt")
def point_clip(spark, d):
    return transforms.point_clip(event_points(spark, d), (5, 2, 1, 30, 20, 20)).select("point_id", "x", "y", "z")


@query(f"WITH {EVENTS}, m AS (SELECT point_id, z, (min(x) OVER p + max(x) OVER p) / 2 AS mx, (min(y) OVER p + max(y) OVER p) / 2 AS my, x, y FROM evt WINDOW p AS ({PERC})) SELECT point_id, round((x-mx)*cos(0.3) - (y-my)*sin(0.3) + mx, 6) AS x, round((x-mx)*sin(0.3) + (y-my)*cos(0.3) + my, 6) AS y, z FROM m")
def rotate_z(spark, d):
    return transforms.Compose([{"type": "rotate", "angle": 0.3}])(event_points(spark, d)).select("point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


COLORS = "col AS (SELECT event_id AS point_id, 0 AS batch, (event_id * 37 % 256)::DOUBLE AS r, (event_id * 91 % 256)::DOUBLE AS g, (event_id * 53 % 256)::DOUBLE AS b FROM events)"


def _colors(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("point_id"), F.lit(0).alias("batch"), *[(F.col("event_id") * m % 256).cast("double").alias(c) for c, m in zip("rgb", (37, 91, 53))])


@query(f"WITH {COLORS} SELECT point_id, r * 0.2989 + g * 0.587 + b * 0.114 AS r FROM col")
def gray(spark, d):
    return transforms.color_gray_scale(_colors(spark, d)).select("point_id", "r")


@query(f"WITH {COLORS} SELECT point_id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM col")
def hsv_round_trip(spark, d):
    return transforms.hue_saturation(_colors(spark, d)).select("point_id", *[F.round(c, 6).alias(c) for c in "rgb"])


@query(f"WITH {COLORS} SELECT point_id, round(r / 127.5 - 1, 9) AS r, round(g / 127.5 - 1, 9) AS g, round(b / 127.5 - 1, 9) AS b FROM col")
def normalize_color(spark, d):
    return transforms.normalize_color(_colors(spark, d)).select("point_id", *[F.round(c, 9).alias(c) for c in "rgb"])


@query(f"WITH {EVENTS} SELECT point_id, ((batch // 2) * 2)::INT AS batch FROM evt")
def mix_pairs(spark, d):
    return transforms.mix_pairs(event_points(spark, d)).select("point_id", "batch")


# windows, patches and refinement


@query(f"WITH {EMB}, {cells_sql('c', 'emb', 0.2, SHIFT)}, w AS (SELECT point_id, batch, gx AS wx, gy AS wy, gz AS wz, floor((x + {SHIFT}) / 0.1) AS sx, floor((y + {SHIFT}) / 0.1) AS sy, floor((z + {SHIFT}) / 0.1) AS sz FROM c) SELECT q.point_id AS query_id, s.point_id AS support_id FROM w q JOIN w s USING (batch, wx, wy, wz) WHERE (q.sx, q.sy, q.sz) <> (s.sx, s.sy, s.sz)")
def window_pairs(spark, d):
    return windows.window_pairs(embedding_points(spark, d), 0.2, 0.1, SHIFT)


@query(f"WITH {EVT_CELLS}, {_morton_steps('c')}, k AS (SELECT *, (batch::BIGINT << 48) | (sx << 2) | (sy << 1) | sz AS code FROM m5), r AS (SELECT batch, point_id, row_number() OVER (PARTITION BY batch ORDER BY code, point_id) - 1 AS rn, count(*) OVER (PARTITION BY batch) AS cnt FROM k) SELECT batch, point_id, rn // 64 AS patch, CASE WHEN rn // 64 = (cnt - 1) // 64 AND cnt % 64 <> 0 THEN rn - (cnt - 64) ELSE rn % 64 END AS place FROM r UNION ALL SELECT batch, point_id, (cnt - 1) // 64, rn - (cnt - 64) FROM r WHERE cnt % 64 <> 0 AND rn >= cnt - 64 AND rn // 64 < (cnt - 1) // 64")
def serialized_patches(spark, d):
    return windows.patches(keys.serialized(_cells(spark, d), "z", 16), 64)


@query(f"WITH {EVT_CELLS}, l AS (SELECT point_id, batch, gx - min(gx) OVER p AS gx, gy - min(gy) OVER p AS gy, gz - min(gz) OVER p AS gz FROM c WINDOW p AS (PARTITION BY batch)) SELECT point_id, (gx * (max(gy) OVER p + 1) + gy) * (max(gz) OVER p + 1) + gz AS key FROM l WINDOW p AS (PARTITION BY batch)")
def ravel_key(spark, d):
    return windows.ravel_key(event_points(spark, d), EVT).select("point_id", "key")


@query(f"WITH {SEG} SELECT target AS class, avg((target = pred)::INT) AS accuracy, count(*) AS n FROM seg GROUP BY GROUPING SETS ((target), ())")
def accuracy(spark, d):
    return windows.accuracy(_seg(spark, d))


@query(f"WITH {EVENTS}, r AS (SELECT batch AS sequence, point_id AS frame, row_number() OVER (PARTITION BY batch ORDER BY point_id) - 1 AS rn, count(*) OVER (PARTITION BY batch) AS cnt FROM evt) SELECT DISTINCT sequence, frame, sha256(sequence || '/' || frame) AS sha256 FROM r JOIN range(7) t(i) ON rn = floor(i * (cnt - 1) / 6)")
def frame_manifest(spark, d):
    return windows.manifest(event_points(spark, d).select(F.col("batch").alias("sequence"), F.col("point_id").alias("frame")), 7)


@query(f"WITH {EMB}, {cells_sql('c', 'emb', 0.1, SHIFT)}, v AS (SELECT batch, gx, gy, gz, min(point_id) AS point_id FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY (point_id * 1103515245 + 12345 + 2) % 2147483648, point_id) AS rn, count(*) OVER (PARTITION BY batch) AS cnt FROM v) SELECT batch, gx, gy, gz, CASE WHEN rn <= floor(cnt * 0.3) THEN 1 WHEN rn <= 2 * floor(cnt * 0.3) THEN 2 ELSE 0 END AS mask FROM r")
def cross_masks(spark, d):
    return windows.cross_masks(embedding_points(spark, d), 0.1, 0.3, 2, SHIFT)


REFINE = f"{EMB.replace('0 AS batch', '(vec_id % 3)::INT AS batch')}, pr AS (SELECT *, (point_id * 7 % 50 // 3)::INT AS pred FROM emb), rare AS (SELECT batch, pred FROM pr GROUP BY ALL HAVING count(*) < 10), bad AS (SELECT pr.* FROM pr JOIN rare USING (batch, pred)), pairs AS (SELECT q.point_id AS query_id, s.point_id AS support_id, {D2} AS d2 FROM bad q JOIN pr s ON q.batch = s.batch), {top_sql('nn', 'pairs', 11)}, vt AS (SELECT query_id, pred, count(*) AS c FROM nn JOIN pr ON pr.point_id = support_id GROUP BY ALL), nw AS (SELECT query_id AS point_id, arg_min(pred, (-c, pred)) AS better FROM vt GROUP BY query_id)"


@query(f"WITH {REFINE} SELECT point_id, batch, coalesce(better, pred) AS pred FROM pr LEFT JOIN nw USING (point_id)")
def refine_parts(spark, d):
    p = embedding_points(spark, d).withColumn("batch", (F.col("point_id") % 3).cast("int")).withColumn("pred", F.expr("cast((point_id * 7 % 50) div 3 as int)"))
    return windows.refine_parts(p, 10)


@query()
def patches_around(spark, d):
    return windows.patches_around(embedding_points(spark, d), 8, K)


@query(f"WITH {REC}, a AS (SELECT room, method, count(*) AS n FROM rec WHERE k = 8 GROUP BY ALL), b AS (SELECT room, method, count(*) AS n FROM rec WHERE k = 16 GROUP BY ALL) SELECT room, method, least(a.n, b.n) AS common FROM a JOIN b USING (room, method)")
def multiset_common(spark, d):
    r = bench_records(spark, d)
    return records.multiset_common(r.where("k = 8"), r.where("k = 16"), ("room", "method"))


@query(f"WITH {REC}, a AS (SELECT DISTINCT room, method FROM rec WHERE k = 8), b AS (SELECT DISTINCT room, method FROM rec WHERE k = 16) SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def key_differences(spark, d):
    r = bench_records(spark, d)
    return records.key_differences(r.where("k = 8"), r.where("k = 16"), ("room", "method"))


@query(f"WITH {REC} SELECT room, method FROM (SELECT DISTINCT room FROM rec) CROSS JOIN (SELECT unnest(['click', 'purchase', 'view']) AS method) EXCEPT SELECT room, method FROM rec")
def required_methods(spark, d):
    return records.lacking(bench_records(spark, d), "method", ("click", "purchase", "view"), ("room",))


@query(f"WITH {REC}, a AS (SELECT event_id, method, k FROM rec WHERE k < 48), b AS (SELECT event_id, method, CASE WHEN event_id % 7 = 0 THEN k + 1 ELSE k END AS k FROM rec WHERE k > 8) SELECT event_id, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'fields' END AS reason FROM a FULL JOIN b USING (event_id) WHERE a.k IS NULL OR b.k IS NULL OR a.method <> b.method OR a.k <> b.k")
def identity_mismatches(spark, d):
    r = bench_records(spark, d)
    other = r.where("k > 8").withColumn("k", F.when(F.col("event_id") % 7 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return records.identity_mismatches(r.where("k < 48"), other, ("event_id",), ("method", "k"))


VARIANTS = ("a", "b", "c")


@query(f"WITH {REC}, r AS (SELECT room, row_number() OVER (ORDER BY room) - 1 AS rn FROM (SELECT DISTINCT room FROM rec)) SELECT room, p::INT AS position, ['a', 'b', 'c'][((rn + p) % 3 + 1)::INT] AS variant FROM r, range(3) t(p)")
def cyclic_order(spark, d):
    return records.cyclic_order(bench_records(spark, d), VARIANTS)


POINT_CANDIDATES = f"{COUNTS}, cc AS (SELECT n.batch, n.gx, n.gy, n.gz, sum(m.cnt)::BIGINT AS candidates FROM n JOIN n m ON m.batch = n.batch AND abs(m.gx-n.gx) <= 1 AND abs(m.gy-n.gy) <= 1 AND abs(m.gz-n.gz) <= 1 GROUP BY ALL), pc AS (SELECT c.batch, candidates FROM c JOIN cc USING (batch, gx, gy, gz))"


@query(f"WITH {POINT_CANDIDATES} SELECT batch, count(*) AS points, round(avg(candidates), 6) AS mean, min(candidates) AS minimum, max(candidates) AS maximum, quantile_cont(candidates::DOUBLE, 0.05) AS p05, quantile_cont(candidates::DOUBLE, 0.25) AS p25, quantile_cont(candidates::DOUBLE, 0.75) AS p75, quantile_cont(candidates::DOUBLE, 0.95) AS p95, quantile_disc(candidates, 0.5) AS median FROM pc GROUP BY batch")
def candidate_distribution(spark, d):
    return cells.candidate_distribution(cells.voxel_counts(event_points(spark, d), EVT)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {POINT_CANDIDATES} SELECT CASE WHEN candidates < 4 THEN 'few' WHEN candidates <= 16 THEN 'some' ELSE 'many' END AS band, count(*) AS points, round(avg(candidates), 6) AS mean FROM pc GROUP BY band")
def candidate_bands(spark, d):
    return cells.candidate_bands(cells.voxel_counts(event_points(spark, d), EVT), 4, 16).withColumn("mean", F.round("mean", 6))


@query(f"WITH {EVT_CELLS}, {_morton_steps('c')} SELECT batch, point_id, row_number() OVER (PARTITION BY batch ORDER BY (sx << 2) | (sy << 1) | sz, point_id) - 1 AS position FROM m5")
def serialized_order(spark, d):
    coded = _cells(spark, d).withColumn("code", keys.morton(F.col("gx"), F.col("gy"), F.col("gz")))
    return cells.serialized_order(coded).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {EVT_CELLS}, r AS (SELECT *, row_number() OVER (v ORDER BY point_id) - 1 AS rn, row_number() OVER (v ORDER BY (point_id * 1103515245 + 12345 + 5) % 2147483648, point_id) AS ch, count(*) OVER v AS cnt FROM c WINDOW v AS (PARTITION BY batch, gx, gy, gz)) SELECT batch, gx, gy, gz, point_id, cnt FROM r WHERE cnt > 1 AND rn = 1 OR cnt <= 1 AND ch = 1")
def grid_sample_member(spark, d):
    return sampling.grid_sample_member(event_points(spark, d), EVT, 1, seed=5)


SLOTS = "slots AS (SELECT point_id AS query_id, r AS rank FROM emb, range(1, 5) t(r)), f AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY support_id) AS rank, support_id, d2 FROM hit) WHERE rank <= 4)"


@query(f"WITH {BALL}, {SLOTS} SELECT query_id, rank, coalesce(f.support_id, o.support_id) AS support_id, coalesce(f.d2, o.d2) AS d2, f.support_id IS NULL AS is_padding FROM slots LEFT JOIN f USING (query_id, rank) LEFT JOIN (SELECT query_id, support_id, d2 FROM f WHERE rank = 1) o USING (query_id)")
def ball_padded_first(spark, d):
    return ball.ball_padded(embedding_points(spark, d), R, 4, pad="first", shift=SHIFT)


@query(f"WITH {BALL}, {SLOTS} SELECT query_id, rank, coalesce(support_id, -1) AS support_id, coalesce(d2, 1e10) AS d2, support_id IS NULL AS is_padding FROM slots LEFT JOIN f USING (query_id, rank)")
def ball_padded_minus_one(spark, d):
    return ball.ball_padded(embedding_points(spark, d), R, 4, pad="minus_one", shift=SHIFT)


@query(f"WITH {EMB}, p AS (SELECT q.point_id AS query_id, s.point_id AS support_id, abs(q.x-s.x)+abs(q.y-s.y)+abs(q.z-s.z) AS distance FROM emb q JOIN emb s ON q.batch = s.batch), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, support_id) AS rank, support_id, distance FROM p WHERE distance < {R}) SELECT * FROM r WHERE rank <= 6")
def radius_l1(spark, d):
    return ball.radius_l1(embedding_points(spark, d), R, 6, shift=SHIFT).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {NB} SELECT query_id, round(sum(exp(-d2 / 0.02) * sf0), 6) AS f0, round(sum(exp(-d2 / 0.02) * sf1), 6) AS f1 FROM g GROUP BY query_id")
def interp_gaussian(spark, d):
    nn, p = _nn(spark, d)
    return neighbors.interpolate_given(neighbors.gaussian_weight(nn, 1.0, 0.1), p, FEATURES).select("query_id", *[F.round(f, 6).alias(f) for f in FEATURES])


@query(f"WITH {EMB} SELECT batch, 0 AS group_id, point_id, x, y, z, f0, f1 FROM emb")
def group_all(spark, d):
    return neighbors.group_all(embedding_points(spark, d), FEATURES)


@query(f"WITH {BALL}, {EXACT_PAIRS}, {top_sql('nn', 'pairs', K)}, f AS (SELECT * FROM (SELECT query_id, support_id, row_number() OVER (PARTITION BY query_id ORDER BY support_id) AS r FROM hit) WHERE r <= {K}) SELECT (SELECT count(*) FROM f JOIN nn USING (query_id, support_id)) / (SELECT count(*) FROM f) AS recall, (SELECT count(*) FROM f) / ((SELECT count(*) FROM emb) * {K}) AS valid_fraction")
def pooled_recall(spark, d):
    p = embedding_points(spark, d)
    return metrics.pooled_recall(knn.knn_exact(p, K), ball.ball_query(p, R, K, mode="first", shift=SHIFT), K)


@query(f"WITH {NB}, s AS (SELECT avg((ql = sl)::INT) AS same FROM g GROUP BY query_id) SELECT floor(same * 100)::BIGINT AS bin, count(*) AS points FROM s GROUP BY ALL")
def boundary_histogram(spark, d):
    return metrics.boundary_histogram(metrics.boundary(*_nn(spark, d)))


from . import scenes  # noqa: E402,F401  registers its queries here
