"""Readers of point-cloud files and record files.  All go through Spark's sources, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clouds(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the cloud files below root, sorted by path when collected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def tables(spark: SparkSession, path: str, defaults: dict | None = None) -> DataFrame:
    """A Parquet point table; columns it lacks are added with a default (segment: -1)."""
    df = spark.read.parquet(path)
    return df.withColumns({c: F.lit(v) for c, v in ({"segment": -1} | (defaults or {})).items() if c not in df.columns})


def room_local(points: DataFrame, digits: int = 3, by: str = "batch") -> DataFrame:
    """Coordinates from each cloud's least corner, rounded half to even."""
    w = Window.partitionBy(by)
    return points.withColumns({a: F.bround(F.col(a) - F.min(a).over(w), digits) for a in "xyz"})


def _floats(width: int, columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(raw.as_buffer(), dtype="<f4").reshape(-1, width)
                for lo in range(0, len(rows), 1 << 17):
                    part = rows[lo : lo + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(lo, lo + len(part))), *[pa.array(part[:, i].astype(np.float64)) for i in range(len(columns))]], ["path", "row", *columns])

    return run


def _ints(kind: str, width: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.frombuffer(raw.as_buffer(), dtype=kind).reshape(-1, width)[:, column].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(v)), pa.array(np.arange(len(v))), pa.array(v)], ["path", "row", "raw"])

    return run


def _stem(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^/.]*)?$", 1)


def _scans(spark: SparkSession, points: str, labels: str | None, width: int, columns: tuple[str, ...], label: tuple[str, int, int]) -> DataFrame:
    kind = "path string, row long, " + ", ".join(f"{c} double" for c in columns)
    binary = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "content")
    scan = binary(points).mapInArrow(_floats(width, columns), kind).withColumn("frame", _stem(F.col("path"))).drop("path")
    if labels is None:
        return scan.withColumn("raw", F.lit(None).cast("long"))
    own = binary(labels).mapInArrow(_ints(*label), "path string, row long, raw long").withColumn("frame", _stem(F.col("path"))).drop("path")
    return scan.join(own, ["frame", "row"], "left")


def mapped(points: DataFrame, mapping: dict[int, int], ignore: int = -1, column: str = "raw", out: str = "segment") -> DataFrame:
    """Raw classes through a learning map; classes without an entry are ignored."""
    if not mapping:
        return points.withColumn(out, F.lit(ignore))
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return points.withColumn(out, F.coalesce(F.try_element_at(table, F.col(column).cast("int")), F.lit(ignore)))


def lidar_xyzi(spark: SparkSession, points: str, labels: str | None = None, mapping: dict[int, int] | None = None, ignore: int = -1) -> DataFrame:
    """Scans of little-endian float32 (x, y, z, strength) with int32 labels whose low 16 bits are the class."""
    out = _scans(spark, points, labels, 4, ("x", "y", "z", "strength"), ("<i4", 1, 0))
    return mapped(out.withColumn("raw", F.col("raw").bitwiseAND(F.lit(65535))), mapping or {}, ignore)


def lidar_ring(spark: SparkSession, points: str, labels: str | None = None, mapping: dict[int, int] | None = None, ignore: int = -1) -> DataFrame:
    """Scans of float32 (x, y, z, strength, ring) with uint8 labels; strength is divided by 255."""
    out = _scans(spark, points, labels, 5, ("x", "y", "z", "strength"), ("u1", 1, 0)).withColumn("strength", F.col("strength") / 255)
    return mapped(out, mapping or {}, ignore)


def lidar_pairs(spark: SparkSession, points: str, labels: str | None = None) -> DataFrame:
    """Scans of float32 (x, y, z, strength) with int32 label pairs, of which the second less 1 is the class."""
    out = _scans(spark, points, labels, 4, ("x", "y", "z", "strength"), ("<i4", 2, 1))
    return out.withColumn("segment", F.coalesce(F.col("raw") - 1, F.lit(-1)))


def shapes_csv(spark: SparkSession, path: str, names: tuple[str, ...] = ("x", "y", "z", "nx", "ny", "nz"), sep: str = ",") -> DataFrame:
    """Clouds as delimited text, one file each."""
    df = spark.read.csv(path, sep=sep, schema=", ".join(f"{n} double" for n in names), recursiveFileLookup=True)
    return df.withColumn("shape", _stem(F.input_file_name()))


def annotated_text(spark: SparkSession, path: str, classes: tuple[str, ...], other: str = "clutter") -> DataFrame:
    """Objects as text files <class>_<n>.txt of x y z r g b: the class comes from the name (unknown ones are ``other``), the instance is
    the file's rank within its room."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("path"), *[parts[i].cast("double").alias(c) for i, c in enumerate("xyzrgb")])
    files = rows.select("path").distinct().withColumn("room", F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1))
    files = files.withColumn("instance", F.dense_rank().over(Window.partitionBy("room").orderBy("path")) - 1)
    named = F.split(_stem(F.col("path")), "_")[0]
    table = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i)])
    files = files.withColumn("segment", F.coalesce(F.try_element_at(table, named), F.lit(classes.index(other))))
    return rows.join(files, "path").drop("path")


def overlap_pairs(spark: SparkSession, path: str, least: float) -> DataFrame:
    """(view1, view2, overlap) rows above a threshold from space-separated text."""
    return spark.read.csv(path, sep=" ", schema="view1 string, view2 string, overlap double").where(F.col("overlap") > least)


def looped(frames: list[DataFrame], loop: int = 1) -> DataFrame:
    """The union of data sets, missing columns null, each row ``loop`` times."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("loop", F.explode(F.sequence(F.lit(1), F.lit(loop))))


def interleaved(frames: list[DataFrame], ratios: list[int], order: str) -> DataFrame:
    """Rows dealt in turns of ``ratios`` rows per data set, until the first is used up; shorter ones start again.

    The turn of a row is its rank div its ratio; the global rank is taken per data set.
    """
    w = Window.partitionBy("source").orderBy(order)
    numbered = None
    for i, f in enumerate(frames):
        f = f.withColumn("source", F.lit(i))
        numbered = f if numbered is None else numbered.unionByName(f, allowMissingColumns=True)
    numbered = numbered.withColumn("rank", F.row_number().over(w) - 1)
    sizes = {r[0]: r[1] for r in numbered.groupBy("source").count().collect()}
    turns = -(-sizes.get(0, 0) // ratios[0])
    again = F.create_map(*[F.lit(v) for i in range(len(frames)) for v in (i, max(1, -(-turns * ratios[i] // max(sizes.get(i, 1), 1))) if i else 1)])
    size = F.create_map(*[F.lit(v) for i in range(len(frames)) for v in (i, sizes.get(i, 0))])
    ratio = F.create_map(*[F.lit(v) for i in range(len(frames)) for v in (i, ratios[i])])
    each = numbered.withColumn("lap", F.explode(F.sequence(F.lit(0), again[F.col("source")] - 1)))
    each = each.withColumn("at", F.col("lap") * size[F.col("source")] + F.col("rank")).withColumn("turn", F.floor(F.col("at") / ratio[F.col("source")]))
    return each.where(F.col("turn") < turns).drop("lap", "rank")


def sweeps(frames: DataFrame, most: int) -> DataFrame:
    """The ``most`` - 1 frames before each frame of a scene with their time lags; the first frame is repeated where there are no more."""
    w = Window.partitionBy("scene").orderBy("ts")
    first = F.first("frame").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("ts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = None
    for i in range(1, most):
        part = frames.select("scene", "frame", F.lit(i).alias("step"), F.coalesce(F.lag("frame", i).over(w), first[0]).alias("sweep"), (F.col("ts") - F.coalesce(F.lag("ts", i).over(w), first[1])).alias("lag"))
        out = part if out is None else out.unionByName(part)
    return out


def mesh_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertex normals: the faces' cross products (twice their area long) summed over each vertex, then of length one."""
    f = faces.select("face", "a", "b", "c")
    for v in "abc":
        f = f.join(vertices.select(F.col("vertex").alias(v), *[F.col(x).alias(f"{v}{x}") for x in "xyz"]), v)
    u = {x: F.col(f"b{x}") - F.col(f"a{x}") for x in "xyz"}
    w = {x: F.col(f"c{x}") - F.col(f"a{x}") for x in "xyz"}
    cross = {"nx": u["y"] * w["z"] - u["z"] * w["y"], "ny": u["z"] * w["x"] - u["x"] * w["z"], "nz": u["x"] * w["y"] - u["y"] * w["x"]}
    f = f.select(F.explode(F.array("a", "b", "c")).alias("vertex"), *[c.alias(n) for n, c in cross.items()])
    s = f.groupBy("vertex").agg(*[F.sum(n).alias(n) for n in cross])
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return s.withColumn("l", F.when(length > 0, length).otherwise(1.0)).select("vertex", *[(F.col(n) / F.col("l")).alias(n) for n in cross])


def json_records(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Record files below path; files that can't be read as JSON are left out."""
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
    return (reader.schema(schema) if schema else reader).json(path)


def timings(df: DataFrame) -> DataFrame:
    """One row per timing of each method from records with methods MAP<STRING, STRUCT<timings ARRAY<STRUCT<...>>>>."""
    each = df.select("room", "mode", "scope", "k", F.explode("methods").alias("method", "m"))
    return each.select("room", "mode", "scope", "k", "method", F.posexplode("m.timings").alias("repeat", "t")).select("room", "mode", "scope", "k", "method", "repeat", "t.*")


def profile_metrics(spark: SparkSession, path: str, metrics: tuple[str, ...], key: str = "Kernel Name", name: str = "Metric Name", value: str = "Metric Value") -> DataFrame:
    """Profiler CSV of key/value rows as one row per kernel; digits may be grouped by commas."""
    df = spark.read.csv(path, header=True, recursiveFileLookup=True)
    return df.groupBy(key).pivot(name, list(metrics)).agg(F.avg(F.regexp_replace(value, ",", "").cast("double")))


#: What a cloud's folder of arrays may hold: columns of each file, and what stands for a file that isn't there.
FIELDS = {
    "coord": (("x", "y", "z"), None), "color": (("r", "g", "b"), None), "normal": (("nx", "ny", "nz"), None),
    "segment": (("segment",), -1.0), "instance": (("instance",), -1.0), "strength": (("strength",), None),
}


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of .npy files: path, row and the row's values."""
    import io

    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
            rows = rows.reshape(len(rows), -1).astype(np.float64)
            for lo in range(0, len(rows), 1 << 16):
                part = rows[lo : lo + (1 << 16)]
                values = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), part.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(lo, lo + len(part))), values], ["path", "row", "value"])


def array_clouds(spark: SparkSession, root: str, splits: tuple[str, ...] = (), names: tuple[str, ...] = (), fields: dict | None = None) -> DataFrame:
    """(split, cloud, row, columns of the fields) of folders root/split/cloud/field.npy (or root/cloud/field.npy without splits).

    A file gives columns by its name (``fields``, FIELDS by default); labels of a cloud that lacks their file are -1, other columns null.
    ``names`` leaves only those clouds.  Rows are told apart by their place in the files, so a cloud's files must be of one length.
    """
    fields = fields or FIELDS
    paths = [f"{root}/{s}" for s in splits] if splits else [root]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(paths).select("path", "content")
    at = F.split("path", "/")
    parts = {"field": F.regexp_replace(F.element_at(at, -1), r"\.npy$", ""), "cloud": F.element_at(at, -2), "split": F.element_at(at, -3) if splits else F.lit(None).cast("string")}
    rows = files.where(parts["field"].isin(*fields) & (parts["cloud"].isin(*names) if names else F.lit(True))).mapInArrow(_arrays, "path string, row long, value array<double>")
    rows = rows.withColumns({n: c for n, c in parts.items()})
    # one row per point: its fields side by side
    value = lambda field, i: F.max(F.when(F.col("field") == field, F.get("value", F.lit(i))))
    columns = [value(field, i).alias(c) for field, (cols, _) in fields.items() for i, c in enumerate(cols)]
    out = rows.groupBy("split", "cloud", "row").agg(*columns)
    filled = {c: F.coalesce(c, F.lit(missing)).cast("int") for cols, missing in fields.values() if missing is not None for c in cols}
    return out.withColumns(filled)


def listed(spark: SparkSession, clouds: DataFrame, lists: dict[str, str], name: str = "cloud") -> DataFrame:
    """clouds with ``split``: the list that names each (JSON arrays of names, of which the part behind the last slash counts); others are left out."""
    out = None
    for split, path in lists.items():
        found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("__n")).select(F.element_at(F.split("__n", "/"), -1).alias("__n"), F.lit(split).alias("split"))
        out = found if out is None else out.unionByName(found)
    return clouds.drop("split").join(F.broadcast(out.dropDuplicates(["__n"])), F.col(name) == F.col("__n")).drop("__n")


def part_clouds(spark: SparkSession, root: str, categories: str = "synsetoffset2category.txt") -> DataFrame:
    """(category, class, cloud, row, x, y, z, nx, ny, nz, part) of text files root/<folder>/<cloud>.txt; the file ``categories`` names each folder's category.

    Classes count categories in the file's order.
    """
    named = spark.read.text(f"{root}/{categories}", wholetext=True).select(F.posexplode(F.split(F.trim("value", F.lit(" \t\r\n")), r"\r?\n")).alias("class", "line"))
    named = named.select("class", F.split(F.trim("line"), r"\s+").alias("w")).select("class", F.get("w", F.lit(0)).alias("category"), F.get("w", F.lit(1)).alias("folder"))
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    at = F.split("path", "/")
    lines = files.select(F.element_at(at, -2).alias("folder"), _stem(F.col("path")).alias("cloud"), F.posexplode(F.split(F.trim("value", F.lit(" \t\r\n")), r"\r?\n")).alias("row", "line"))
    lines = lines.where(F.trim("line") != "")
    cells = F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.try_cast("double"))
    rows = lines.join(F.broadcast(named), "folder").select("category", "class", "cloud", "row", cells.alias("v"))
    columns = ("x", "y", "z", "nx", "ny", "nz")
    return rows.select("category", "class", "cloud", F.col("row").cast("long").alias("row"), *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(columns)], F.get("v", F.lit(6)).cast("int").alias("part"))
