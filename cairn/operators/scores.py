"""Choices among scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def choose(candidates: DataFrame, keys: list[str], margin: float = 0.06) -> DataFrame:
    """The best candidate of each group by score, `order` breaking ties; the previous shape's candidate wins if the two best are closer than the margin.

    candidates: keys, shape, score, order, prev (the previous shape, or null).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "order")
    r = candidates.withColumns({"_r": F.row_number().over(w), "_next": F.lead("score").over(w)})
    g = r.groupBy(*keys).agg(F.min_by(F.struct("shape", "score"), "_r").alias("_best"), F.min_by(F.col("score") - F.col("_next"), "_r").alias("_gap"), F.min_by(F.struct("shape", "score"), F.when(F.col("shape") == F.col("prev"), F.col("_r"))).alias("_old"))
    chosen = F.when((F.col("_gap") < margin) & F.col("_old").isNotNull(), F.col("_old")).otherwise(F.col("_best"))
    return g.withColumn("_c", chosen).select(*keys, "_c.shape", "_c.score")
