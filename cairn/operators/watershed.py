"""Watershed of many frames at once: a minimum spanning forest that grows from markers.

Flooding from markers, always over the cheapest edge between flooded and dry pixels, joins every pixel to the marker that it reaches over the
lowest pass: a minimum spanning forest with a root in each marker. An edge's cost is the largest step of a colour channel between its two
pixels; edges of equal cost are ordered by their two pixel numbers, which is the stated order of arrival, so the forest is one and the same whatever
the order in which it is built. It is built in rounds: every dry region takes the cheapest edge that leaves it, and the regions so linked become
one; each round at least halves the dry regions. A round is joins and aggregates over all edges left, of all frames, and ends in a written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .cloud import numbered
from .raster import UV, _offsets, areas, distance_transform, pixel_components

#: Links that are followed in one round; longer chains go on in the next.
_JUMPS = 3


def _step() -> Column:
    return F.greatest(*[F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) for c in ("r", "g", "b")])


def _pixel_edges(pixels: DataFrame, key: str) -> DataFrame:
    """(a, b, cost): neighbouring pixels (8 neighbours) of a frame, a before b by number."""
    at = [key, *UV]
    to = pixels.select(key, F.col("id").alias("a"), F.struct("r", "g", "b").alias("x"), *UV, _offsets([(1, 0), (-1, 1), (0, 1), (1, 1)], ("du", "dv")).alias("o"))
    to = to.select(key, "a", "x", (F.col("u") + F.col("o.du")).alias("u"), (F.col("v") + F.col("o.dv")).alias("v"))
    met = to.join(pixels.select(*at, F.col("id").alias("b"), F.struct("r", "g", "b").alias("y")), at)
    return met.select("a", "b", _step().cast("int").alias("cost"))


def flood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, label) of every node that a marker reaches. edges: (a, b, cost), a < b, each once; seeds: (id, label), labels from 1, unique over all frames.

    A region is named by one of its nodes, a marker by the negative of its label. Of the edges between two regions the first by (cost, a, b) is enough.
    """
    mark = seeds.select("id", (-F.col("label")).alias("c"))

    def named(e: DataFrame, names: DataFrame) -> DataFrame:
        for end in "ab":
            e = e.join(names.select(F.col("id").alias(f"n{end}"), F.col("c").alias("_c")), f"n{end}", "left").withColumn(f"n{end}", F.coalesce("_c", f"n{end}")).drop("_c")
        left = e.filter("na <> nb AND (na >= 0 OR nb >= 0)").select(F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb"), "k")
        return left.groupBy("na", "nb").agg(F.min("k").alias("k"))

    key = F.struct("cost", "a", "b").alias("k")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).union(seeds.select("id")).distinct()
    where = cut(nodes.join(mark, "id", "left").select("id", F.coalesce("c", "id").alias("c")))
    e = cut(named(edges.select(F.col("a").alias("na"), F.col("b").alias("nb"), key), mark))
    while not e.isEmpty():
        both = e.union(e.select("nb", "na", "k"))
        link = both.filter("na >= 0").groupBy("na").agg(F.min(F.struct("k", F.col("nb").alias("to"))).alias("m")).select(F.col("na").alias("id"), F.col("m.to").alias("c"))
        # Two regions that take the same edge would follow each other: the smaller name stays.
        back = link.select(F.col("id").alias("c"), F.col("c").alias("_back"))
        link = link.join(back, "c", "left").filter("_back IS NULL OR _back <> id OR id > c").select("id", "c")
        for _ in range(_JUMPS):
            link = link.join(link.select(F.col("id").alias("c"), F.col("c").alias("_next")), "c", "left").select("id", F.coalesce("_next", "c").alias("c"))
        link = cut(link)
        moved = where.join(link.select(F.col("id").alias("c"), F.col("c").alias("_c")), "c", "left")
        where = cut(moved.select("id", F.coalesce("_c", "c").alias("c")))
        e = cut(named(e, link))
    return where.filter("c < 0").select("id", (-F.col("c")).alias("label"))


def watershed_split(pixels: DataFrame, keys: Sequence[str], h: int, w: int, peak_ratio: float = 0.38, least: int = 300) -> DataFrame:
    """(keys, u, v, part, reason) for the masks of pixels (keys, u, v, r, g, b): several parts where a mask has several broad places, else one.

    Broad places are the parts of `least` pixels or more in which the distance to the background is over peak_ratio of the mask's greatest; they are
    the markers, and parts that end up with fewer than `least` pixels are left out. reason: watershed_split, or why the mask stays one part:
    mask_too_small, distance_transform_too_small, peak_components<2 or watershed_not_split.
    """
    number = numbered(pixels.select(*keys).distinct(), [], keys, "_frame")
    p = cut(pixels.join(number, list(keys)).withColumn("id", F.col("_frame") * (h * w) + F.col("v") * w + F.col("u")))
    size = p.groupBy("_frame").agg(F.count("*").alias("n"))
    dist = distance_transform(p, h, w, ["_frame"])
    top = dist.groupBy("_frame").agg(F.max("dist").alias("top"))
    broad = dist.join(top, "_frame").filter(F.col("dist") > peak_ratio * F.col("top")).select("_frame", *UV)
    peaks = cut(pixel_components(broad, ["_frame"], w, 8, frame=F.col("_frame"), h=h))
    seeds = areas(peaks, ["_frame"]).filter(F.col("area") >= least).select("_frame", "label")
    plan = size.join(top, "_frame").join(seeds.groupBy("_frame").agg(F.count("*").alias("k")), "_frame", "left")
    stays = F.when(F.col("n") < 2 * least, "mask_too_small").when(F.col("top") < 1, "distance_transform_too_small").when(F.coalesce("k", F.lit(0)) < 2, "peak_components<2")
    plan = cut(plan.select("_frame", stays.alias("stays")))
    cuts = plan.filter("stays IS NULL").select("_frame")
    marks = cut(numbered(seeds.join(cuts, "_frame", "left_semi"), [], ["_frame", "label"], "m").withColumn("m", F.col("m") + 1))
    marked = peaks.join(marks, ["_frame", "label"]).select((F.col("_frame") * (h * w) + F.col("v") * w + F.col("u")).alias("id"), F.col("m").alias("label"))
    flooded = flood(_pixel_edges(p.join(cuts, "_frame", "left_semi"), "_frame"), marked)
    first = marks.groupBy("_frame").agg(F.min("m").alias("_m"))
    parts = p.select("_frame", "id").join(flooded, "id").join(first, "_frame").select("_frame", "id", (F.col("label") - F.col("_m") + 1).cast("int").alias("part"))
    large = parts.groupBy("_frame", "part").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    split = large.groupBy("_frame").agg(F.count("*").alias("k")).filter("k > 1").select("_frame", F.lit(True).alias("_split"))
    plan = plan.join(split, "_frame", "left").select("_frame", F.when(F.col("_split"), "watershed_split").otherwise(F.coalesce("stays", F.lit("watershed_not_split"))).alias("reason"))
    # Parts keep their order and are numbered without those that are left out.
    rank = large.alias("x").join(large.alias("y"), F.expr("x._frame = y._frame AND y.part <= x.part")).groupBy("x._frame", "x.part").agg(F.count("*").cast("int").alias("_part"))
    several = parts.join(rank, ["_frame", "part"]).select("id", F.col("_part").alias("part"))
    out = p.join(plan, "_frame").join(several, "id", "left").withColumn("part", F.when(F.col("reason") == "watershed_split", F.col("part")).otherwise(1))
    return out.filter("part IS NOT NULL").select(*keys, *UV, "part", "reason")
