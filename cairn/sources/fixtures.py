"""Point, pixel and observation views over the plain tables, for queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

H, W = 48, 64
#: Camera of the pixel view: fx, fy, cx, cy, and the depth unit in metres.
K = (60.0, 60.0, 32.0, 24.0)
SCALE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    xyz = [e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "r", "g", "b"))]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("obj"), *xyz)


#: Half sizes of the objects of surfaces(), by label modulo 3: a ball, a box and a cylinder.
SIZES = ((0.02, 0.02, 0.02), (0.035, 0.022, 0.012), (0.016, 0.016, 0.045))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface points of objects half a metre apart, an object for each label: every three elements of a vector are a direction from its centre.

    Three elements without a direction (all zero, null or not finite) are no point, and a row without a label is of no object.
    """
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").filter((F.size(e) >= 3) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    colour = [F.get(e, F.lit(i)).cast("double").alias(n) for i, n in ((3, "r"), (4, "g"), (5, "b"))]
    found = rows.select(F.col("vec_id").alias("pid"), F.col("label").alias("obj"), e, *colour, F.explode(F.sequence(F.lit(0), F.size(e) - 3, F.lit(3))).alias("i"))
    found = found.select("pid", "obj", "r", "g", "b", *[F.get(e, F.col("i") + k).cast("double").alias(n) for k, n in enumerate("xyz")])
    x, y, z = (F.col(n) for n in "xyz")
    kind = F.pmod("obj", F.lit(3))
    length = F.when(kind == 0, F.sqrt(x * x + y * y + z * z)).when(kind == 1, F.greatest(F.abs(x), F.abs(y), F.abs(z))).otherwise(F.greatest(F.sqrt(x * x + y * y), F.abs(z)))
    some = [F.when(kind == 0, a).when(kind == 1, b).otherwise(c) for a, b, c in zip(*SIZES, strict=True)]
    found = found.withColumn("n", length).filter((F.col("n") > 0) & (F.col("n") < float("inf")) & x.isNotNull() & y.isNotNull() & z.isNotNull())
    return found.select("pid", "obj", (x / F.col("n") * some[0] + F.col("obj") * 0.5).alias("x"), *[(c / F.col("n") * s).alias(n) for n, c, s in (("y", y, some[1]), ("z", z, some[2]))], "r", "g", "b")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % W).cast("int").alias("u"), ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % H).cast("int").alias("v"), "l_quantity")
    return cells.groupBy("u", "v").agg((F.min("l_quantity") * 20).cast("int").alias("depth_u16"))


def mask(spark: SparkSession, sf_dir: str, most: int = 60) -> DataFrame:
    """Pixels up to a depth; about a third of the image at the larger scales."""
    return pixels(spark, sf_dir).filter(F.col("depth_u16") <= most).select("u", "v")


#: The same views in SQL, to be put in front of a query.
SQL = """
v_points AS (SELECT vec_id AS pid, label AS obj, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
  CAST(embedding[4] AS DOUBLE) AS r, CAST(embedding[5] AS DOUBLE) AS g, CAST(embedding[6] AS DOUBLE) AS b FROM embeddings),
v_pixels AS (SELECT CAST(l_orderkey % 64 AS INTEGER) AS u, CAST((l_partkey * 31 + l_suppkey) % 48 AS INTEGER) AS v, CAST(MIN(l_quantity) * 20 AS INTEGER) AS depth_u16 FROM lineitem GROUP BY 1, 2),
v_mask AS (SELECT u, v FROM v_pixels WHERE depth_u16 <= 60),
v_grid AS (SELECT CAST(a.range AS INTEGER) AS u, CAST(b.range AS INTEGER) AS v FROM range(64) a, range(48) b)
"""
