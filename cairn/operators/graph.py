"""Connected components: minimum labels over edges with pointer jumping, a written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): every node with the smallest id of its component.

    nodes has the long column id, edges the columns a and b; loops, repeats and either direction are fine. A round takes the
    least label of each node's neighbours, and then the label of its label, so rounds grow with the logarithm of the diameter.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").filter("a <> b").distinct())
    label = cut(nodes.select("id", F.col("id").alias("label")))
    before = None
    while True:
        least = both.join(label, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        near = label.join(least, "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = near.alias("x").join(near.alias("y"), F.col("x.label") == F.col("y.id"), "left")
        label = cut(jump.select(F.col("x.id").alias("id"), F.coalesce(F.col("y.label"), F.col("x.label")).alias("label")))
        now = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return label
        before = now
