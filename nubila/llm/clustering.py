"""Exact k-means over integer vectors; Yinyang bounds decide which centroids a vector is measured against.

The centroids are put into groups once.  A vector keeps an upper bound of the distance to its centroid and, for each group,
one lower bound of the distance to all other centroids of that group.  When centroids move, bounds move by as much; a vector
whose lower bounds all stay above its upper bound keeps its centroid, else groups are ruled out one by one, then centroids of
the groups that are left, and only what survives is measured.  Distances are exact integers, bounds have room for rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import real_id, row_key
from .workspace import Workspace

K, DIM, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Vectors of a block (a row of the tables between rounds), and the largest size of a component: squared distances fit 64 bits.
BLOCK, LARGEST = 8192, 1 << 27
#: Components up to this size are multiplied as doubles without rounding.
_AS_DOUBLE = 1 << 21


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c, as 64-bit integers."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= _AS_DOUBLE and x.shape[1] <= 64:
        xf, cf = x.astype(float), c.astype(float)
        return ((xf * xf).sum(1)[:, None] + (cf * cf).sum(1) - 2 * (xf @ cf.T)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids, from those farthest apart."""
    c = centroids.astype(float)
    at = [0]
    near = ((c - c[0]) ** 2).sum(1)
    while len(at) < groups:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((c - c[at[-1]]) ** 2).sum(1))
    middle = c[at]
    for _ in range(rounds):
        group = ((c[:, None] - middle) ** 2).sum(2).argmin(1)
        for g in np.unique(group):
            middle[g] = c[group == g].mean(0)
    return group


def assign_all(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bound by group) from all distances; of equal distances the smaller number wins."""
    d = squared(x, centroids)
    cluster = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), cluster].astype(float))
    far = np.sqrt(d.astype(float))
    far[np.arange(len(x)), cluster] = np.inf
    lower = np.stack([far[:, group == g].min(1) if (group == g).any() else np.full(len(x), np.inf) for g in range(int(group.max()) + 1)], axis=1)
    return cluster, upper, lower


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids have moved by ``drift``, and how many distances were measured."""
    most = np.array([drift[group == g].max(initial=0.0) for g in range(lower.shape[1])])
    old, low = lower, lower - most
    cluster, upper = cluster.copy(), upper + drift[cluster]
    finite = np.where(np.isfinite(old), old, 0.0)
    slack = 1e-9 * (1 + upper + finite.max(1, initial=0.0) + drift.max())
    rows = np.flatnonzero(low.min(1) <= upper + slack)
    measured = len(rows)
    best2 = np.zeros(len(rows), np.int64)
    for c in np.unique(cluster[rows]):
        mine = cluster[rows] == c
        best2[mine] = squared(x[rows[mine]], centroids[c : c + 1])[:, 0]
    upper[rows] = np.sqrt(best2.astype(float))
    still = low[rows].min(1) <= upper[rows] + slack[rows]
    rows, best2 = rows[still], best2[still]
    own, best, own2 = cluster[rows], cluster[rows], best2.copy()
    for g in range(low.shape[1]):
        hit = np.flatnonzero(low[rows, g] <= np.sqrt(best2.astype(float)) + slack[rows])
        members = np.flatnonzero(group == g)
        if not len(hit) or not len(members):
            continue
        r, room = rows[hit], np.sqrt(best2[hit].astype(float)) + slack[rows[hit]]
        here = x[r]
        # of each centroid of the group its distance, or the bound that ruled it out
        exact = np.full((len(r), len(members)), np.iinfo(np.int64).max)
        dist = old[r, g][:, None] - drift[members]
        for j, c in enumerate(members):
            scan = np.flatnonzero((dist[:, j] <= room) & (own[hit] != c))
            if len(scan):
                exact[scan, j] = squared(here[scan], centroids[c : c + 1])[:, 0]
                dist[scan, j] = np.sqrt(exact[scan, j].astype(float))
                measured += len(scan)
            # a vector's centroid is none of the others, unless an earlier group had a nearer one
            mine = own[hit] == c
            dist[mine, j] = np.where(best[hit[mine]] == c, np.inf, np.sqrt(own2[hit[mine]].astype(float)))
        first = exact.argmin(1)
        found2, found = exact[np.arange(len(r)), first], members[first]
        better = (found2 < best2[hit]) | ((found2 == best2[hit]) & (found < best[hit]))
        dist[better, first[better]] = np.inf
        low[r, g] = dist.min(1)
        # the centroid that was the best until now belongs to its own group's others
        w, before = r[better], best[hit][better]
        low[w, group[before]] = np.minimum(low[w, group[before]], np.sqrt(best2[hit][better].astype(float)))
        best[hit[better]], best2[hit[better]] = found[better], found2[better]
    cluster[rows], upper[rows] = best, np.sqrt(best2.astype(float))
    return cluster, upper, low, measured


_BLOCK = "n int, ids binary, x binary, cluster binary, upper binary, lower binary, distance binary, measured long, parts array<bigint>"


def _row(ids: np.ndarray, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, measured: int, last: bool) -> pa.RecordBatch:
    """A block: its vectors, their bounds, and per cluster the number of vectors, the sum of distances (in the last round) and the sums of components."""
    k = len(centroids)
    kind = "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4"
    distance = np.zeros(len(x), np.int64)
    parts = np.zeros((k, 2 + x.shape[1]), np.int64)
    for c in np.unique(cluster):
        mine = cluster == c
        parts[c, 0] = mine.sum()
        parts[c, 2:] = x[mine].sum(0, dtype=np.int64)
        if last:
            distance[mine] = squared(x[mine], centroids[c : c + 1])[:, 0]
            # as Python's integers, so that a sum beyond 64 bits fails instead of wrapping around
            parts[c, 1] = sum(distance[mine].tolist())
    values = [len(x), ids.astype("<i8").tobytes(), x.astype(kind).tobytes(), cluster.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes(), distance.astype("<i8").tobytes() if last else b"", measured, parts.ravel()]
    types = [pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split(" ")[0] for c in _BLOCK.split(", ")])


def _first(centroids: np.ndarray, group: np.ndarray, last: bool):
    dim = centroids.shape[1]

    def block(ids: list, vectors: list) -> pa.RecordBatch:
        x = np.concatenate(vectors)
        if np.abs(x).max() > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST}: squared distances would not fit 64 bits")
        return _row(np.concatenate(ids), x, *assign_all(x, centroids, group), centroids, len(x) * len(centroids), last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy(zero_copy_only=False).copy())
                # clipped beyond the largest size, so that its absolute value exists
                vectors.append(np.clip(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), -LARGEST - 1, LARGEST + 1))
                held += batch.num_rows
            if held >= BLOCK:
                yield block(ids, vectors)
                ids, vectors, held = [], [], 0
        if held:
            yield block(ids, vectors)

    return run


def _again(centroids: np.ndarray, drift: np.ndarray, group: np.ndarray, last: bool):
    dim, groups = centroids.shape[1], int(group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                x = np.frombuffer(r["x"], "<i2" if len(r["x"]) == 2 * n * dim else "<i4").reshape(n, dim)
                *state, measured = reassign(x, np.frombuffer(r["cluster"], "<i4").astype(np.int64), np.frombuffer(r["upper"], "<f8"), np.frombuffer(r["lower"], "<f8").reshape(n, groups), centroids, drift, group)
                yield _row(np.frombuffer(r["ids"], "<i8"), x, *state, centroids, measured, last)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], "<i8")), pa.array(np.frombuffer(r["cluster"], "<i4")), pa.array(np.frombuffer(r["distance"], "<i8"))], ["did", "cluster", "distance"])


def kept_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(did, x): floor(scale * component) of the vectors that have ``dim`` components, none null or not finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    return vectors.where(v.isNotNull() & (F.size(v) == dim) & F.forall(v, fine)).select(row_key(F.col(f"`{id_col}`")).alias("did"), F.transform(v, lambda e: F.floor(e * scale)).alias("x"))


def _totals(blocks: DataFrame, k: int, dim: int) -> np.ndarray:
    """Sums over all blocks: k * (2 + dim) numbers."""
    out = np.zeros(k * (2 + dim), np.int64)
    for r in blocks.select(F.posexplode("parts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(k, 2 + dim)


def centroid_clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, stats: dict | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that is kept.

    Kept are vectors of ``dim`` components, none null or not finite; a component counts as floor(scale * x).  The first
    centroids are the k vectors of the least sha256 of "seed:id", in that order (rows of one id: the smaller vector first);
    rows without an id come last.  Fewer than k vectors give fewer centroids.  Each round assigns every vector to the nearest
    centroid, the smaller number among equals, and moves a centroid to the floor of its vectors' mean; a centroid without
    vectors stays.  After the rounds vectors are assigned once more.

    Null ids stay null, repeated rows count each, other columns are ignored, no vectors give no rows.  A component
    beyond 2**27 after scaling is an error, because a squared distance would not fit a long.

    A round is one pass over blocks of vectors; nothing is shuffled but k * (dim + 2) sums a block, added up in the map tasks first.
    ``stats`` receives the number of distances measured in each round.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "clusters")
    kept = kept_vectors(vectors, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), real_id().cast("string")), 256)
    start = kept.select("did", "x", name.alias("name")).orderBy(F.asc_nulls_last("name"), "did", "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.x for r in start], np.int64)
    if np.abs(centroids).max() > LARGEST or centroids.min() < -LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}: squared distances would not fit 64 bits")
    group = grouped(centroids, max(1, len(start) // 10))
    blocks = ws.save(kept.mapInArrow(_first(centroids, group, rounds == 0), _BLOCK), "round")
    for step in range(1, rounds + 1):
        totals = _totals(blocks, len(start), dim)
        size = totals[:, :1]
        moved = np.where(size > 0, totals[:, 2:] // np.maximum(size, 1), centroids)
        drift = np.sqrt(((moved - centroids).astype(float) ** 2).sum(1)) * (1 + 1e-12)
        before, centroids = blocks, moved
        blocks = ws.save(before.mapInArrow(_again(centroids, drift, group, step == rounds), _BLOCK), "round")
        ws.drop(before)
        if stats is not None:
            stats[step] = blocks.agg(F.sum("measured")).first()[0]
    inertia = [int(v) for v in _totals(blocks, len(start), dim)[:, 1]]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # k rows
    each = spark.createDataFrame([(i, inertia[i], sum(inertia), digest[i]) for i in range(len(start))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    members = blocks.select("ids", "cluster", "distance").mapInArrow(_members, "did long, cluster int, distance long")
    return members.join(F.broadcast(each), "cluster").select(real_id().alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute_force_sql(k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in SQL: all distances in every round."""
    out = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INTEGER AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        out.append(f"d{i} AS MATERIALIZED (SELECT vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d2 FROM v, c{i})")
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(c, (d2, c)) AS c, min(d2) AS d2 FROM d{i} GROUP BY vec_id)")
        if i < rounds:
            out.append(f"s{i} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY c, i)")
            out.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{i} GROUP BY c)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))")
    last = f"SELECT vec_id, a{rounds}.c AS cluster, d2 AS distance, (sum(d2) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d2) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    return "WITH " + ", ".join(out) + " " + last
