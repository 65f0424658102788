"""MinHash near-duplicate detection with fast similarity sketches, banding and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .textcore import P_WORD, U, Words, chunks, distinct_by_row, list_array, mix, shingles
from .workspace import KeyFilter, Workspace

#: Rows without an id get nodes from here on, so that a real id is always the smaller one.
NO_ID = 1 << 62
BANDS, ROWS = 32, 4
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def node_of(doc_id: Column, text: Column) -> Column:
    spare = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    own = doc_id.cast("long")
    return F.when(own >= NO_ID, F.raise_error(F.lit("ids must be below 2**62"))).otherwise(F.coalesce(own, spare))


def fast_similarity_sketch(at: np.ndarray, values: np.ndarray, bins: int) -> np.ndarray:
    """(rows, bins) sketches; at and values are the sets of the rows.

    Round i < bins throws every element of a set into the bin that round's hash names, with a value in [i, i+1);
    round bins + j throws all of them into bin j, so that every bin is filled after 2 * bins rounds at the latest.
    A bin keeps its least value.  A set stops after the first round that leaves no bin of it empty; as values grow
    with the round, later rounds could not change it.  Over the shared elements the expected share of equal
    bins is the Jaccard similarity, with the concentration of independent samples.
    """
    rows = len(at) - 1
    out = np.full(rows * bins, _EMPTY)
    r, v = np.repeat(np.arange(rows), np.diff(at)), values
    open_ = np.diff(at) > 0
    for i in range(2 * bins):
        h = mix(v + U((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        if i < bins:
            to = (h >> U(40)).astype(np.int64) % bins
        else:
            to = np.full(len(v), i - bins)
        # the round in the high bits, 48 bits of hash below: a total order over rounds
        np.minimum.at(out, r * bins + to, (U(i) << U(48)) | (mix(h) >> U(16)))
        left = np.flatnonzero(open_)
        full = left[~(out.reshape(rows, bins)[left] == _EMPTY).any(axis=1)]
        if len(full):
            open_[full] = False
            live = open_[r]
            r, v = r[live], v[live]
        if len(r) == 0:
            break
    return out.reshape(rows, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(rows of sketch, bands) keys; equal keys mean an equal band at an equal place."""
    parts = mix(sketch + U(1)).reshape(len(sketch), bands, rows)
    weights = np.array([pow(P_WORD, i + 1, 1 << 64) for i in range(rows)], dtype=U)
    return mix((parts * weights).sum(axis=2, dtype=U) + np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15))


def _sketches(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                at, values = distinct_by_row(*shingles(Words(data, off, lower=True), size), hi - lo)
                n = np.diff(at)
                keys = band_keys(fast_similarity_sketch(at, values, bands * rows), bands, rows)
                keys = keys[n > 0].ravel()
                total = np.zeros((2, len(values) + 1), U)
                np.cumsum(mix(values), out=total[0, 1:])
                np.cumsum(mix(values ^ U(0x5851F42D4C957F2D)), out=total[1, 1:])
                f1, f2 = (mix(t[at[1:]] - t[at[:-1]]) for t in total)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), list_array(np.concatenate([[0], np.cumsum((n > 0) * bands)]), keys), batch.column(2).slice(lo, hi - lo)],
                    ["node", "n", "f1", "f2", "bands", "row"],
                )

    return run


def _sets(shared, bits: int, size: int):
    from .workspace import test_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = test_bits(shared.value, bits, batch.column(0).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            for lo, hi, data, off in chunks(batch.column(1)):
                at, values = distinct_by_row(*shingles(Words(data, off, lower=True), size), hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), list_array(at, values)], ["node", "set"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least that similarity."""
    sa = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(sa, "a").join(sb, "b")
        .select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u"))
        .where(F.lit(100) * F.col("i") >= F.lit(percent) * F.col("u"))
        .select("a", "b")
    )


#: Members of a bucket that are compared as single pairs at most; larger buckets are compared in blocks of BLOCK members.
SMALL, BLOCK = 32, 256


def _links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between the asking and the asked members of one pair of blocks; only links leave the task."""
        asks = table.column("asks").to_numpy()
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets = table.column("set").combine_chunks()
        off, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
        size = np.diff(off)
        asked = np.flatnonzero(~asks)
        pool = np.concatenate([values[off[i] : off[i + 1]] for i in asked]) if len(asked) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(asked)), size[asked])
        order = np.argsort(pool, kind="stable")
        pool, owner = pool[order], owner[order]
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(asks):
            mine = values[off[i] : off[i + 1]]
            lo, hi = np.searchsorted(pool, mine), np.searchsorted(pool, mine, side="right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(asked))
            ok = (100 * common >= percent * (size[i] + size[asked] - common)) & (component[asked] != component[i])
            # one link to a component joins all of it
            _, once = np.unique(component[asked][ok], return_index=True)
            out += [(node[i], node[j]) for j in asked[ok][once]]
        return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})

    return run


def _crowded(ws: Workspace, held: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links within the large buckets of held (key, node, component), and the rows of the small ones.

    In a large bucket, the members outside its largest component are the asking ones: blocks of them meet blocks of all
    members, and each pair of blocks is a group of its own, so no task holds a whole bucket and no pair is written
    that isn't a link.
    """
    parts = held.groupBy("key", "component").agg(F.count("*").alias("k"))
    main = parts.groupBy("key").agg(F.sum("k").alias("c"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("main"))
    large = main.where(f"c > {SMALL}")
    small = held.join(large.select("key"), "key", "left_anti")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    inside = held.join(large, "key").withColumn("nq", F.greatest(blocks(F.col("c") - F.col("most")), F.lit(1))).withColumn("nt", blocks(F.col("c")))
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = inside.where("component <> main").select("key", "node", "component", F.lit(True).alias("asks"), spot("nq").alias("q"), each("nt").alias("t"))
    asked = inside.select("key", "node", "component", F.lit(False).alias("asks"), each("nq").alias("q"), spot("nt").alias("t"))
    rows = asking.unionByName(asked).join(sets, "node")
    links = rows.groupBy("key", "q", "t").applyInArrow(_links(percent), "a long, b long").distinct()
    return ws.save(links, "crowd"), small


def components_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, n, component, first) for near_duplicates(), one row per row of docs; of rows without an id that have equal texts, one is first."""
    ws = Workspace(docs.sparkSession, "near")
    src = docs.select(node_of(F.col(id_col), F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))
    # the numbers of the rows hold once they are written
    numbered = src.withColumn("row", F.monotonically_increasing_id())
    seen = ws.save(numbered.mapInArrow(_sketches(bands, rows, size), "node long, n long, f1 long, f2 long, bands array<long>, row long"), "sketches")
    some = seen.where("n > 0")
    classes = ws.save(some.groupBy("f1", "f2").agg(F.min("node").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    keys = classes.select(F.col("rep").alias("node"), "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("pivot"), F.min_by("node", F.xxhash64("node")).alias("other")).where("c > 1")
    members = ws.save(keys.join(shared.select("key", "pivot", "other"), "key").select("key", "node", "n", "pivot", "other"), "members")
    sizes = classes.select(F.col("rep").alias("node"), "n")

    def in_reach(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity."""
        na, nb = (sizes.groupBy(F.col("node").alias(x)).agg(F.max("n").alias(f"n{x}"), F.min("n").alias(f"m{x}")) for x in "ab")
        return pairs.join(na, "a").join(nb, "b").where(f"100 * na >= {percent} * mb and 100 * nb >= {percent} * ma").select("a", "b")

    # rows of one id with different sets are one node from the start
    several = some.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
    same_id = some.join(several, "node", "left_semi").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    links = ws.save(same_id.distinct(), "links")

    involved = members.select("node").distinct()
    involved = ws.save(involved, "involved")
    count = involved.count()
    if count:
        bitmap = KeyFilter(involved, "node", count)
        near = src.mapInArrow(_sets(bitmap.shared, bitmap.bits, size), "node long, set array<long>")
        sets = ws.save(near.where(F.size("set") > 0).join(involved, "node", "left_semi"), "sets")
        done = None
        labels = None
        for step in ("pivot", "pivots", "rest"):
            held = members.select("key", "node", "pivot", "other")
            if labels is None:
                held = held.withColumn("component", F.col("node"))
            else:
                held = held.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
                split = held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
                held = held.join(split, "key", "left_semi")
            crowd = None
            if step == "rest":
                crowd, held = _crowded(ws, ws.save(held.select("key", "node", "component"), "rest"), sets, percent)
                left, right = (held.select("key", F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
                pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
            else:
                stars = ["pivot"] if step == "pivot" else ["pivot", "other"]
                pairs = held.select("node", F.explode(F.array(*stars)).alias("to")).where("node <> to")
                pairs = pairs.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"), "node")
                if step == "pivot":  # for each member the pivot that it meets most often
                    pairs = pairs.groupBy("a", "b", "node").agg(F.count("*").alias("c"))
                    pairs = pairs.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("c", -F.col("a"))).alias("p")).select("p.a", "p.b")
                else:
                    root = labels.select(F.col("node"), F.col("component"))
                    pairs = (
                        pairs.select("a", "b").distinct()
                        .join(root.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
                        .join(root.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
                        .where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
                    )
                pairs = pairs.distinct()
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = ws.save(in_reach(pairs), "pairs")
            if crowd is not None or not pairs.isEmpty():
                done = pairs if done is None else done.unionByName(pairs)
                found = _similar(pairs, sets, percent)
                found = ws.save(found.unionByName(crowd) if crowd is not None else found, "found")
                if not found.isEmpty():
                    links = links.unionByName(found)
                    labels = ws.save(connected_components(ws, links), "labels")
            if labels is None:
                labels = ws.save(connected_components(ws, links), "labels")
            ws.release()
    else:
        labels = ws.save(connected_components(ws, links), "labels")

    reps = classes.select("f1", "f2", "rep")
    roots = labels.select(F.col("node").alias("rep"), "component")
    copies = some.where(F.col("node") >= F.lit(NO_ID)).groupBy("node", "f1", "f2").agg(F.min("row").alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
    whole = (
        some.select("node", "n", "f1", "f2", "row").join(reps, ["f1", "f2"]).join(roots, "rep", "left").join(ws.save(copies, "copies"), ["node", "f1", "f2"], "left")
        .select("node", "n", F.coalesce("component", "rep").alias("component"), F.coalesce(F.col("row") == F.col("lead"), F.lit(True)).alias("first"))
    )
    bare = seen.where("n = 0").select("node", "n", F.col("node").alias("component"), F.lit(True).alias("first"))
    return whole.unionByName(bare)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    Sets of distinct shingles of ``size`` words (A-Z lower-cased) are linked when their similarity is at least
    ``percent``; component_id is the smallest id that links reach.

    Equal sets are one class, and only its smallest id goes on.  A class's band keys meet in buckets; within a
    bucket, members are confirmed against pivots first, and only members that are then still in different components
    are compared with each other, so a bucket of many copies costs about one comparison per copy, yet no link that
    would join two components is left out.  Candidates are found by banding (a pair at 0.75 is missed with
    probability 5e-6); confirmation is exact.

    Null or empty text, or text without words: an empty set, linked with nothing.  Null ids: the row takes part, its
    component_id is null unless it is linked with a row that has an id, and it is kept if it stands for its
    component; of equal texts without an id one row is kept.  An id of 2**62 or more is an error.  Rows with the same id are one node, and kept or not
    together.  Other columns of docs are ignored.
    """
    found = components_of(docs, id_col=id_col, text_col=text_col, size=size, percent=percent, bands=bands, rows=rows)
    with_id = lambda c: F.when(F.col(c) < F.lit(NO_ID), F.col(c))
    return found.select(with_id("node").alias("doc_id"), F.col("n").alias("n_shingles"), with_id("component").alias("component_id"), ((F.col("node") == F.col("component")) & F.col("first")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stand for their components, with the columns of docs.

    Of rows with an equal text and the same id, or none, one stays; rows without words are copies of nothing and stay.
    Different texts of one id that stands for its component stay too: they need not be near copies.
    """
    ws = Workspace(docs.sparkSession, "near-drop")
    found = components_of(docs, id_col=id_col, text_col=text_col, **how)
    nodes = found.groupBy("node").agg(F.bool_or(F.col("node") != F.col("component")).alias("gone"), F.count_if(F.col("n") > 0).alias("c")).where("gone or c > 1")
    # names that docs doesn't have
    node, mark = (next(f"{name}{k or ''}" for k in range(len(docs.columns) + 1) if f"{name}{k or ''}" not in docs.columns) for name in ("node", "blank"))
    marks = ws.save(nodes.select(F.col("node").alias(node), "gone"), "marks")
    rows = docs.withColumn(node, node_of(F.col(id_col), F.col(text_col)))
    single = rows.join(marks.select(node), node, "left_anti")
    # one copy of each text; rows without words differ by number
    blank = F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    several = rows.join(marks.where("not gone").select(node), node, "left_semi").withColumn(mark, blank)
    several = several.dropDuplicates([node, text_col, mark])
    return single.drop(node).unionByName(several.select(*[F.col(f"`{c}`") for c in docs.columns]))
