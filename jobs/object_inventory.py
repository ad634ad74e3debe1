"""Inventory of a scanned scene: the support plane is fitted and taken out, every object's cloud is thinned and measured, and the measures are written by status.

Somebody who scanned a table wants to know what stands on it: how many points each object has left off the table, where it is, how large and how
dense it is, what it is likely to look like, and which objects were seen too poorly to be used. The output is one Parquet dataset, partitioned by
`status` (ok, too_few_points, bad_shape), one row an object. A run replaces the whole dataset, so it can be repeated.

Rows without an object, a point number or a finite coordinate are no points; an object of which nothing is left off the plane is in the inventory with 0 points.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import stats
from cairn.functions.exprs import XYZ, finite
from cairn.operators import cloud

from .common import main

log = logging.getLogger("jobs.object_inventory")

MEASURES = ("cx", "cy", "cz", "ex", "ey", "ez", "scale", "density", "s1", "s2", "s3", "mean_r", "mean_g", "mean_b")
SCHEMA = f"obj int, raw long, kept long, n long, {', '.join(f'{c} double' for c in MEASURES)}, status string"


def points_of(table: DataFrame) -> DataFrame:
    """(obj, pid, x, y, z, r, g, b): the first three components of a vector are its place, the next three its colour."""
    at = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate((*XYZ, "r", "g", "b"))]
    return table.select(F.col("label").cast("int").alias("obj"), F.col("vec_id").alias("pid"), *at).filter(finite() & F.col("obj").isNotNull() & F.col("pid").isNotNull())


def inventory(points: DataFrame, config: dict) -> DataFrame:
    """One row of SCHEMA an object."""
    keys, plane, digits = ["obj"], config["plane"], config["round_digits"]
    off = cloud.segment_points(points, plane["thickness"], plane["distance"], plane["iterations"], plane["min_inlier_ratio"]).drop("status")
    thin = cloud.voxel_mean(off, keys, config["voxel"], ("r", "g", "b")).drop("n")
    scales = stats.shape_flags(stats.pca_scales(thin, keys)).select(*keys, "s1", "s2", "s3", "bad_shape")
    measured = stats.summary(thin, keys).join(scales, keys).join(stats.mean_colour(thin, keys), keys)
    raw = points.groupBy(*keys).agg(F.count("*").alias("raw"))
    kept = off.groupBy(*keys).agg(F.count("*").alias("kept"))
    out = raw.join(kept, keys, "left").join(measured, keys, "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("kept", "n")}
    status = F.when(n["n"] < config["least_points"], "too_few_points").when(F.col("bad_shape"), "bad_shape").otherwise("ok")
    return out.select(*keys, "raw", n["kept"].alias("kept"), n["n"].alias("n"), *[(F.round(c, digits) + 0.0).alias(c) for c in MEASURES], status.alias("status"))


def run(spark: SparkSession, points: str, out: str, config: dict) -> dict:
    """Writes the inventory of a scanned scene, by status."""
    table = points_of(spark.read.parquet(points))
    log.info("reads %s", points)
    inventory(table, config).write.mode("overwrite").partitionBy("status").parquet(out)
    written = {r.status: r.n for r in read(spark, out).groupBy("status").agg(F.count("*").alias("n")).collect()}
    used = read(spark, out).agg(F.sum("raw")).first()[0] or 0
    log.info("read %d points, wrote %s to %s", used, written or "no object", out)
    return {"points": used, "objects": written}


def read(spark: SparkSession, out: str) -> DataFrame:
    """What run() wrote."""
    return spark.read.schema(SCHEMA).parquet(out)


if __name__ == "__main__":
    main("object_inventory", run, {"points": "table of vectors (vec_id, label, embedding), each a point with its colour", "out": "folder of the inventory"})
