"""Writers of results."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Append the records whose keys the table at path lacks; a new table if there is none.

    Existing rows are never rewritten, so an interrupted run leaves whole records only.
    """
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    df.write.mode("append").parquet(path)


class KeyedTable:
    """Records by key below a path, changed as a whole or not at all.

    A change writes its records to a folder of their own and then puts a new manifest, the list of all folders that count, in place by a rename.
    Until then readers see the table as it was; a writer that dies leaves a folder that no manifest names.  A manifest has a number
    and is never written over, so of two writers that began with the same table one fails and can go again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at().getFileSystem(self.conf)

    def version(self) -> int:
        """The number of the latest manifest, 0 if there is none."""
        fs, at = self._fs(), self._at("manifests")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n)), default=0)

    def layers(self, version: int | None = None) -> list[str]:
        """Folders of the table, the oldest first."""
        version = self.version() if version is None else version
        if not version:
            return []
        found = self._fs().open(self._at("manifests", f"{version:012d}.json"))
        try:
            return json.loads(bytes(found.readAllBytes()).decode())["layers"]
        finally:
            found.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The records, each key's from the newest folder that has it; None if nothing was ever written."""
        out, newer = None, None
        for name in reversed(self.layers(version)):
            layer = self.spark.read.parquet(f"{self.path}/{name}")
            if newer is not None:
                on = None
                for k in self.keys:
                    same = layer[k].eqNullSafe(newer[f"__{k}"])
                    on = same if on is None else on & same
                layer = layer.join(newer, on, "left_anti")
            out = layer if out is None else out.unionByName(layer, allowMissingColumns=True)
            # keys of a folder are unique, those of several need not be
            seen = self.spark.read.parquet(f"{self.path}/{name}").select(*[F.col(k).alias(f"__{k}") for k in self.keys])
            newer = seen if newer is None else newer.unionByName(seen)
        return out

    def _commit(self, version: int, layers: list[str]) -> None:
        """Put manifest number version + 1 in place; an error if another writer has."""
        fs, name = self._fs(), f"{version + 1:012d}.json"
        staged = self._at("staged", f"{uuid.uuid4().hex}.json")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps({"layers": layers}).encode()))
        out.close()
        fs.mkdirs(self._at("manifests"))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            # fails where the name is taken
            context.rename(staged, self._at("manifests", name), options)
        except Py4JJavaError as taken:
            fs.delete(staged, False)
            raise RuntimeError(f"another writer has made version {version + 1} of {self.path}") from taken

    def upsert(self, df: DataFrame, conflict: str = "replace", before_commit=None) -> int:
        """Add records; the version that has them.

        A key that the table has is replaced, kept (``skip``: equal or not) or an error where its record differs (``error``; an equal one
        is skipped).  Keys of df must be unique.
        """
        version = self.version()
        layers, old = self.layers(version), self.read(version)
        name = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
        if old is not None and conflict != "replace":
            if conflict == "error":
                values = [c for c in df.columns if c not in self.keys]
                both = df.select(*self.keys, F.struct(*values).alias("__new")).join(old.select(*self.keys, F.struct(*values).alias("__old")), list(self.keys))
                bad = both.where(~F.col("__new").eqNullSafe(F.col("__old"))).limit(1).collect()
                if bad:
                    raise ValueError(f"conflicting record for {[bad[0][k] for k in self.keys]}")
            df = df.join(old.select(*self.keys), list(self.keys), "left_anti")
        df.write.parquet(f"{self.path}/{name}")
        written = self.spark.read.parquet(f"{self.path}/{name}")
        if not written.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("keys are not unique")
        if before_commit is not None:
            before_commit()
        self._commit(version, [*layers, name])
        return version + 1

    def compact(self) -> int:
        """The same records in one folder; older versions stay readable."""
        version = self.version()
        records = self.read(version)
        if records is None:
            return 0
        name = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
        records.write.parquet(f"{self.path}/{name}")
        self._commit(version, [name])
        return version + 1

    def remaining(self, todo: DataFrame) -> DataFrame:
        """Rows of todo whose key the table lacks: what a resumed run still has to do."""
        done = self.read()
        return todo if done is None else todo.join(done.select(*self.keys), list(self.keys), "left_anti")


def replaced(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old with the records of new in place of its own; new keys must all be there."""
    if not new.join(old.select(*keys), list(keys), "left_anti").isEmpty():
        raise ValueError("a replacement has no record to replace")
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def markdown(df: DataFrame, rows: int = 200) -> str:
    """The first rows as a Markdown table (a report; for small results)."""
    got = df.limit(rows).collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *[line(r) for r in got]])


def predictions(df: DataFrame, path: str, inverse: dict[int, int] | None = None) -> None:
    """Per-point predictions by cloud, through an inverse class map if one is given."""
    if inverse:
        table = F.create_map(*[F.lit(v) for kv in inverse.items() for v in kv])
        df = df.withColumn("pred", table[F.col("pred")])
    df.write.mode("overwrite").partitionBy("batch").parquet(path)


def ply_points(df: DataFrame, path: str) -> None:
    """ASCII PLY body rows "x y z[ r g b]" and, beside them, the header with the number of points."""
    cols = [c for c in ("x", "y", "z", "r", "g", "b") if c in df.columns]
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode("overwrite").text(f"{path}/body")
    head = ["ply", "format ascii 1.0", f"element vertex {df.count()}"]
    head += [f"property {'float' if c in 'xyz' else 'uchar'} {dict(r='red', g='green', b='blue').get(c, c)}" for c in cols] + ["end_header"]
    df.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def events(df: DataFrame, path: str) -> None:
    """Append scalar events as JSON lines."""
    df.write.mode("append").json(path)
