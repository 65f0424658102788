"""Voxel sampling, crops and farthest point sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ball import lcg
from .cells import CELL, with_cells
from .ranks import running, with_groups


def grid_sample(points: DataFrame, size: float, seed: int = 0, shift: float = 0.0) -> DataFrame:
    """One point of each voxel, chosen by a seeded scramble of ids, and its displacement from the voxel's centre."""
    cells = with_cells(points, size, shift)
    row = F.struct("point_id", "x", "y", "z")
    one = cells.groupBy(*CELL).agg(F.min_by(row, F.struct(lcg(F.col("point_id"), seed), "point_id")).alias("p"), F.count("*").alias("cnt"))
    return one.select(*CELL, "p.point_id", "cnt", *[((F.col(f"p.{a}") + shift) / size - F.col(f"g{a}") - 0.5).alias(f"disp_{a}") for a in "xyz"])


def grid_sample_parts(points: DataFrame, size: float, shift: float = 0.0) -> DataFrame:
    """As many parts of a cloud as its fullest voxel has points; part i takes member i modulo the voxel's count."""
    w = Window.partitionBy(*CELL)
    cells = with_cells(points, size, shift).withColumns({"rn": F.row_number().over(w.orderBy("point_id")).cast("long") - 1, "cnt": F.count("*").over(w)})
    parts = cells.groupBy("batch").agg(F.max("cnt").alias("parts"))
    each = cells.join(F.broadcast(parts), "batch").select("point_id", "batch", "rn", "cnt", "parts")
    # member rn is in the parts rn, rn + cnt, rn + 2 cnt, ...
    return each.select("point_id", "batch", F.explode(F.sequence(F.col("rn"), F.col("parts") - 1, F.col("cnt"))).alias("part"))


def sphere_crop(points: DataFrame, centre: tuple[float, float, float], n: int, least: int = 0) -> DataFrame:
    """The n points of each batch nearest to the centre; batches with fewer than least points give none."""
    d = [F.col(a) - F.lit(float(c)) for a, c in zip("xyz", centre)]
    w = Window.partitionBy("batch").orderBy("d2", "point_id")
    out = points.withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    if least:
        out = out.join(points.groupBy("batch").count().where(F.col("count") >= least).select("batch"), "batch", "left_semi")
    return out


def _placed(points: DataFrame, order: Column) -> DataFrame:
    """points with a row's place rn in its batch by (order, id) and the batch's count cnt."""
    placed = running(points.select("batch", "point_id", order.alias("__by")), ["batch"], ["__by", "point_id"], name="rn").drop("__by", "batch")
    return with_groups(points.join(placed, "point_id"), points.groupBy("batch").agg(F.count("*").alias("cnt")), ["batch"])


def even_sample(points: DataFrame, n: int, order: Column | str = "point_id") -> DataFrame:
    """n evenly spaced ranks of each batch (ends included), fewer where a batch has fewer; ids are unique."""
    ranked = _placed(points, F.col(order) if isinstance(order, str) else order)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("cnt") - 1) / F.lit(max(n - 1, 1))))
    return ranked.where(F.array_contains(wanted, F.col("rn"))).select(*points.columns)


def dropout(points: DataFrame, keep: float, seed: int = 0) -> DataFrame:
    """floor(keep * n) points of each batch, chosen by a seeded scramble; ids are unique."""
    return _placed(points, lcg(F.col("point_id"), seed)).where(F.col("rn") < F.floor(F.col("cnt") * keep)).select(*points.columns)


def shuffled(points: DataFrame, seed: int = 0) -> DataFrame:
    """points with ``position``, a place 0.. in its batch by a seeded scramble of ids; ids are unique."""
    placed = running(points.select("batch", "point_id", lcg(F.col("point_id"), seed).alias("__by")), ["batch"], ["__by", "point_id"])
    return points.join(placed.select("point_id", "position"), "point_id")


def member_crop(points: DataFrame, n: int, *, seed: int = 0, least: int = 0, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(batch, point_id, rank, position): of each batch the n points nearest to one of its own, drawn by a seeded scramble of ids.

    rank counts from the nearest (by distance along ``axes``, then id), position the points that are left in order of ids, which keeps
    points together that were.  Batches with fewer than ``least`` points give none.  Axes may be whole-numbered cells.
    """
    middle = points.groupBy("batch").agg(F.min_by(F.struct(*axes), F.struct(lcg(F.col("point_id"), seed), "point_id")).alias("__m"), F.count("*").alias("__n"))
    d = [F.col(a) - F.col(f"__m.{a}") for a in axes]
    near = with_groups(points.select("batch", "point_id", *axes), middle, ["batch"]).where(F.col("__n") >= least)
    near = near.select("batch", "point_id", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("__d2"))
    kept = running(near, ["batch"], ["__d2", "point_id"], name="rank").where(F.col("rank") < n)
    return running(kept.select("batch", "point_id", "rank"), ["batch"], ["point_id"])


def farthest_points(points: DataFrame, n: int, skip_origin: bool = False) -> DataFrame:
    """Farthest point sampling within each batch: start at the smallest id, then again and again the point farthest from those
    taken (smallest id among equals).  Sequential in a batch by nature, so batches are the units of work.
    skip_origin leaves out points with a squared norm of 1e-3 or less."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        xyz = pdf[["x", "y", "z"]].to_numpy()
        if skip_origin:
            far = (xyz**2).sum(axis=1) > 1e-3
            pdf, xyz = pdf[far], xyz[far]
        taken, best = [], np.full(len(xyz), np.inf)
        at = 0
        for _ in range(min(n, len(xyz))):
            taken.append(at)
            d = xyz - xyz[at]
            best = np.minimum(best, d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
            at = int(np.argmax(best))
        return pd.DataFrame({"batch": pdf["batch"].to_numpy()[taken], "step": np.arange(1, len(taken) + 1), "point_id": pdf["point_id"].to_numpy()[taken]})

    return points.select("point_id", "batch", "x", "y", "z").groupBy("batch").applyInPandas(run, "batch int, step long, point_id long")


def crops_until_covered(points: DataFrame, n: int) -> DataFrame:
    """Repeated nearest-n crops until every point is covered; the next centre is the point of least priority so far.

    A crop raises a member's priority by (1 - d/max d)**2.  Sequential in a batch by nature.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        xyz, out = pdf[["x", "y", "z"]].to_numpy(), []
        priority, covered, crop = np.zeros(len(pdf)), np.zeros(len(pdf), bool), 0
        while not covered.all():
            d = ((xyz - xyz[int(np.argmin(priority))]) ** 2).sum(axis=1)
            near = np.argsort(d, kind="stable")[:n]
            top = d[near].max()
            priority[near] += (1 - d[near] / top) ** 2 if top > 0 else 1.0
            covered[near] = True
            out.append(pd.DataFrame({"batch": pdf["batch"][near], "crop": crop, "point_id": pdf["point_id"][near]}))
            crop += 1
        return pd.concat(out) if out else pd.DataFrame({"batch": [], "crop": [], "point_id": []})

    return points.select("point_id", "batch", "x", "y", "z").groupBy("batch").applyInPandas(run, "batch int, crop long, point_id long")


def grid_sample_member(points: DataFrame, size: float, pick: int, seed: int = 0, shift: float = 0.0) -> DataFrame:
    """Member number pick (by id, from 0) of each voxel; of voxels with fewer points the one that a seeded scramble chooses."""
    w = Window.partitionBy(*CELL)
    chance = F.row_number().over(w.orderBy(lcg(F.col("point_id"), seed), "point_id")) - 1
    cells = with_cells(points, size, shift).withColumns({"rn": F.row_number().over(w.orderBy("point_id")) - 1, "chance": chance, "cnt": F.count("*").over(w)})
    return cells.where(((F.col("cnt") > pick) & (F.col("rn") == pick)) | ((F.col("cnt") <= pick) & (F.col("chance") == 0))).select(*CELL, "point_id", "cnt")
