"""Outlines of masks and straight lines in them, for all masks of all frames at once.

A mask is the set of its pixels (keys, u, v) and may lie anywhere; nothing here needs the size of an image. An outline runs through the centres
of boundary pixels, so its area and length are sums over 2 by 2 blocks of pixels: of four foreground pixels a block holds a whole square, of
three a half and its diagonal, of two the edge between them, on either side of which there is a block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .cloud import numbered
from .raster import UV, pixel_components

#: Angles of lines, in steps of a degree from 0: the cosine and the sine of each.
TURNS = [(math.cos(math.pi * a / 180), math.sin(math.pi * a / 180)) for a in range(180)]

#: Votes that a line needs, empty pixels that a run of it may leap, least length of a run, and the share of the longer side that it needs too.
VOTES, GAP, SHORTEST, SIDE = 20, 3, 8, 0.15


def connected(mask: DataFrame, keys: Sequence[str], neighbours: int = 8) -> DataFrame:
    """(keys, u, v, label): connected parts of every mask; label is the same for the pixels of a part, and smaller for a part whose first pixel by rows comes first."""
    ends = mask.agg(*[f(c) for c in UV for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return mask.select(*keys, *UV, F.lit(0).cast("long").alias("label"))
    w, h = ends[1] - ends[0] + 1, ends[3] - ends[2] + 1
    number = numbered(mask.select(*keys).distinct(), [], keys, "_g")
    moved = mask.select(*keys, (F.col("u") - ends[0]).alias("u"), (F.col("v") - ends[2]).alias("v")).join(number, list(keys))
    parts = pixel_components(moved, ["_g"], w, neighbours, frame=F.col("_g"), h=h)
    return parts.select(*keys, (F.col("u") + ends[0]).cast("int").alias("u"), (F.col("v") + ends[2]).cast("int").alias("v"), "label")


def filled(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, u, v): every mask with its holes, the background that its surroundings don't reach over 4 neighbours. Pixels outside the mask's box are never looked at."""
    box = mask.groupBy(*keys).agg((F.min("u") - 1).alias("_u"), (F.min("v") - 1).alias("_v"), (F.max("u") - F.min("u") + 3).alias("_w"), (F.max("v") - F.min("v") + 3).alias("_h"))
    cells = box.withColumn("_i", F.explode(F.sequence(F.lit(0), F.expr("CAST(_w * _h - 1 AS INT)"))))
    cells = cells.select(*keys, F.expr("CAST(_u + _i % _w AS INT)").alias("u"), F.expr("CAST(_v + _i DIV _w AS INT)").alias("v"))
    back = cut(cells.join(mask.select(*keys, *UV), [*keys, *UV], "left_anti"))
    labels = connected(back, keys, 4)
    around = labels.join(box.select(*keys, F.col("_u").cast("int").alias("u"), F.col("_v").cast("int").alias("v")), [*keys, *UV], "left_semi").select(*keys, "label")
    return mask.select(*keys, *UV).distinct().unionByName(labels.join(around, [*keys, "label"], "left_anti").select(*keys, *UV))


def outlines(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, area, length, w, h, valid, circularity, aspect_ratio, rectangularity) of the outer outline with the largest area of every mask, the first among equals.

    An outline of an area up to 1 is not valid, and its ratios are 0.
    """
    parts = cut(connected(cut(filled(mask, keys)), keys))
    corner = F.explode(F.array(*[F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv"), F.lit(bit).alias("bit")) for du, dv, bit in ((0, 0, 1), (-1, 0, 2), (0, -1, 4), (-1, -1, 8))]))
    blocks = parts.select(*keys, "label", *UV, corner.alias("o")).groupBy(*keys, "label", (F.col("u") + F.col("o.du")).alias("_u"), (F.col("v") + F.col("o.dv")).alias("_v")).agg(F.sum("o.bit").cast("int").alias("_p"))
    n = F.bit_count("_p")
    area = F.when(n == 4, 1.0).when(n == 3, 0.5).otherwise(0.0)
    length = F.when(n == 3, math.sqrt(2)).when(F.col("_p").isin(6, 9), 2 * math.sqrt(2)).when(n == 2, 1.0).otherwise(0.0)
    measured = blocks.groupBy(*keys, "label").agg(F.sum(area).alias("area"), F.sum(length).alias("length"), (F.max("_u") - F.min("_u")).alias("w"), (F.max("_v") - F.min("_v")).alias("h"))
    best = measured.groupBy(*keys).agg(F.max_by(F.struct("area", "length", "w", "h"), F.struct("area", -F.col("label"))).alias("b")).select(*keys, "b.*")
    valid = (F.col("area") > 1.0) & (F.col("length") > 1e-6)
    ratios = {"circularity": 4 * math.pi * F.col("area") / (F.col("length") * F.col("length")), "aspect_ratio": F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1)), "rectangularity": F.col("area") / F.greatest(F.col("w") * F.col("h"), F.lit(1))}
    return best.withColumns({"valid": valid} | {k: F.when(valid, v).otherwise(0.0) for k, v in ratios.items()})


def line_votes(mask: DataFrame, keys: Sequence[str], least: int = VOTES) -> DataFrame:
    """(keys, angle, rho, votes): the lines u cos + v sin = rho, to the nearest pixel, that `least` pixels of a mask lie on."""
    turn = F.explode(F.array(*[F.struct(F.lit(i).alias("angle"), F.lit(c).alias("c"), F.lit(s).alias("s")) for i, (c, s) in enumerate(TURNS)]))
    at = mask.select(*keys, *UV, turn.alias("t")).select(*keys, "t.angle", F.rint(F.col("u") * F.col("t.c") + F.col("v") * F.col("t.s")).cast("int").alias("rho"))
    return at.groupBy(*keys, "angle", "rho").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def on_lines(mask: DataFrame, keys: Sequence[str], least: int = VOTES) -> DataFrame:
    """(keys, u, v, angle, rho): every pixel with the line through it that has most votes, the least angle among equals. Pixels on no line go."""

    def choose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        u, v = a["u"].to_numpy(float), a["v"].to_numpy(float)
        best, line = np.zeros(len(a), np.int64), np.zeros((2, len(a)), np.int64)
        for angle, rows in b.groupby("angle", sort=True):
            low = int(rows["rho"].min())
            votes = np.zeros(int(rows["rho"].max()) - low + 3, np.int64)  # with a 0 on either side for what lies outside
            votes[rows["rho"].to_numpy() - low + 1] = rows["votes"]
            rho = np.rint(u * TURNS[angle][0] + v * TURNS[angle][1]).astype(np.int64)
            n = votes[np.clip(rho - low + 1, 0, len(votes) - 1)]
            better = n > best
            best[better], line[0, better], line[1, better] = n[better], angle, rho[better]
        return a.assign(angle=line[0], rho=line[1])[best > 0]

    types = ", ".join(f"`{k}` {mask.schema[k].dataType.simpleString()}" for k in keys)
    pixels = mask.select(*keys, *[F.col(c).cast("int").alias(c) for c in UV])
    return pixels.groupBy(*keys).cogroup(line_votes(pixels, keys, least).groupBy(*keys)).applyInPandas(choose, f"{types}, u int, v int, angle int, rho int")


def line_runs(mask: DataFrame, keys: Sequence[str], shortest: DataFrame, votes: int = VOTES, gap: int = GAP) -> DataFrame:
    """(keys, angle, rho, u0, v0, u1, v1, length): straight runs of every mask. shortest: (keys, least), the least length of a run along u or v.

    Each pixel counts for one line, the one of most votes, and a run goes on over up to `gap` missing pixels, counted along the axis that the line is nearer to.
    """
    p = on_lines(mask, keys, votes)
    flat = F.col("angle").between(45, 135)
    p = p.withColumns({"_a": F.when(flat, F.col("u")).otherwise(F.col("v")), "_b": F.when(flat, F.col("v")).otherwise(F.col("u"))})
    line = Window.partitionBy(*keys, "angle", "rho").orderBy("_a", "_b")
    p = p.withColumn("_new", (F.col("_a") - F.lag("_a").over(line) > gap + 1).cast("int"))
    p = p.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("_a", "_b", *UV)
    runs = p.groupBy(*keys, "angle", "rho", "_run").agg(F.min(at).alias("f"), F.max(at).alias("l"))
    runs = runs.select(*keys, "angle", "rho", F.col("f.u").alias("u0"), F.col("f.v").alias("v0"), F.col("l.u").alias("u1"), F.col("l.v").alias("v1"))
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    long = runs.join(shortest, list(keys)).filter(F.greatest(F.abs(du), F.abs(dv)) >= F.col("least"))
    return long.select(*keys, "angle", "rho", "u0", "v0", "u1", "v1", F.sqrt((du * du + dv * dv).cast("double")).alias("length"))


def line_support(mask: DataFrame, keys: Sequence[str], found: DataFrame, votes: int = VOTES) -> DataFrame:
    """(keys, runs, line_support): the number of straight runs of every mask of outlines() `found`, and their length against that of the outline, at most 1."""
    shortest = found.select(*keys, F.greatest(F.lit(SHORTEST), F.floor(SIDE * F.greatest("w", "h"))).alias("least"))
    total = line_runs(mask, keys, shortest, votes).groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("length").alias("_l"))
    out = found.select(*keys, "length", "valid").join(total, list(keys), "left")
    share = F.least(F.coalesce("_l", F.lit(0.0)) / F.greatest("length", F.lit(1.0)), F.lit(1.0))
    return out.select(*keys, F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), F.when(F.col("valid"), share).otherwise(0.0).alias("line_support"))


def features(mask: DataFrame, keys: Sequence[str], votes: int = VOTES) -> DataFrame:
    """outlines() with line_support() of every mask."""
    found = cut(outlines(mask, keys))
    return found.join(line_support(mask, keys, found, votes), list(keys))
