"""Association of observed objects with fixed templates: one to one, cheapest pairs first, all keyframes of all recordings at once.

Templates are the objects of a recording's first keyframe. A later object meets the templates near it through a grid whose cells are as wide as the
gate, so pairs are made only in reach. Matching takes the cheapest pair of a keyframe that is left, and then the next, until none is: a pair that is the
first choice of both its template and its object is in that matching whatever comes before it, so all such pairs are taken together, round after round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.exprs import XYZ
from ..plans.lineage import cut

#: What an object is known by: median centre, extent between the 5th and 95th percentile, mean colour.
SIGNATURE = (*(f"c{c}" for c in XYZ), *(f"e{c}" for c in XYZ), "mean_r", "mean_g", "mean_b")


def signatures(points: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """(keys, n, SIGNATURE) of every object of at least `least` points."""
    found = stats.summary(points, keys).join(stats.mean_colour(points, keys), list(keys))
    return found.filter(F.col("n") >= least).select(*keys, "n", *SIGNATURE)


def _distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def candidates(objects: DataFrame, templates: DataFrame, frame: Sequence[str], gate: float) -> DataFrame:
    """(frame, local_id, global_id, cost) of objects (frame, local_id, SIGNATURE) and templates (rec_id, global_id, SIGNATURE) whose centres are nearer than the gate.

    The cost is the distance of the centres, then the differences of extent and of colour at a tenth of their weight.
    """
    cell = lambda c, k=0: (F.floor(F.col(c) / gate) + k).cast("long")
    around = F.explode(F.array(*[F.struct(*[cell(f"c{c}", k).alias(f"i{c}") for c, k in zip(XYZ, o, strict=True)]) for o in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]]))
    near = templates.select("rec_id", "global_id", F.struct(*SIGNATURE).alias("t"), around.alias("at")).select("rec_id", "global_id", "t", *[f"at.i{c}" for c in XYZ])
    met = objects.select(*frame, "local_id", F.struct(*SIGNATURE).alias("o"), *[cell(f"c{c}").alias(f"i{c}") for c in XYZ]).join(near, ["rec_id", *[f"i{c}" for c in XYZ]])
    d = {n: _distance([F.col(f"t.{c}") for c in part], [F.col(f"o.{c}") for c in part]) for n, part in (("centre", SIGNATURE[:3]), ("extent", SIGNATURE[3:6]), ("colour", SIGNATURE[6:]))}
    cost = d["centre"] + 0.1 * d["extent"] + F.lit(0.1 * gate) * d["colour"]
    return met.filter(d["centre"] < gate).select(*frame, "local_id", "global_id", cost.alias("cost"))


def greedy(pairs: DataFrame, frame: Sequence[str]) -> DataFrame:
    """(frame, local_id, global_id): pairs by cost, cheapest first, every template and object of a frame once; ties go to the lower template and then to the earlier object."""
    left, done = cut(pairs), None
    order = ["cost", "global_id", "local_id"]
    while True:
        first = lambda *by: F.row_number().over(Window.partitionBy(*frame, *by).orderBy(*order)) == 1
        taken = cut(left.withColumn("_t", first("global_id")).withColumn("_o", first("local_id")).filter("_t AND _o").select(*frame, "local_id", "global_id"))
        done = taken if done is None else done.unionByName(taken)
        left = cut(left.join(taken.select(*frame, "global_id"), [*frame, "global_id"], "left_anti").join(taken.select(*frame, "local_id"), [*frame, "local_id"], "left_anti"))
        if left.isEmpty():
            return done


def assign_fixed(points: DataFrame, gate: float = 0.10, least: int = 1) -> DataFrame:
    """(rec_id, keyframe_index, local_id, n, global_id) of every object in points (rec_id, keyframe_index, local_id, x, y, z, r, g, b).

    The objects of a recording's first keyframe are its templates, numbered from 1 by local_id; a later object gets one of them or -1. An object of fewer
    than `least` points is no template and gets -1.
    """
    frame = ["rec_id", "keyframe_index"]
    seen = cut(signatures(points, [*frame, "local_id"], 0))
    usable = seen.filter(F.col("n") >= least)
    start = usable.groupBy("rec_id").agg(F.min("keyframe_index").alias("_first"))
    usable = usable.join(start, "rec_id")
    number = F.row_number().over(Window.partitionBy("rec_id").orderBy("local_id"))  # the objects of one keyframe
    templates = cut(usable.filter("keyframe_index = _first").withColumn("global_id", number))
    matched = greedy(candidates(usable.filter("keyframe_index > _first"), templates, frame, gate), frame)
    given = templates.select(*frame, "local_id", "global_id").unionByName(matched)
    return seen.select(*frame, "local_id", "n").join(given, [*frame, "local_id"], "left").select(*frame, "local_id", "n", F.coalesce("global_id", F.lit(-1)).alias("global_id"))


def fused_summary(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """(rec_id, global_id, num_points, num_members, members, SIGNATURE): every identity with its members and the signature of its template.

    members are structs (keyframe_index, local_id) in order; a recording has one an object and keyframe at most. num_points counts all their points.
    """
    ids = ["rec_id", "global_id"]
    found = assigned.filter("global_id > 0")
    every = found.groupBy(*ids).agg(F.sum("n").alias("num_points"), F.count("*").alias("num_members"), F.array_sort(F.collect_list(F.struct("keyframe_index", "local_id"))).alias("members"))
    first = found.groupBy(*ids).agg(F.min_by("local_id", "keyframe_index").alias("local_id"), F.min("keyframe_index").alias("keyframe_index"))
    of = points.join(first, ["rec_id", "keyframe_index", "local_id"], "left_semi")
    template = signatures(of, ["rec_id", "keyframe_index", "local_id"]).join(first, ["rec_id", "keyframe_index", "local_id"]).select(*ids, *SIGNATURE)
    return every.join(template, ids)


def nearest(objects: DataFrame, templates: DataFrame, radius: float) -> DataFrame:
    """(objects' columns but x, y, z; global_id, dist): the template (global_id, x, y, z) nearest to every object (pid, x, y, z), the lower one among equals.

    Objects meet templates in cells as wide as the radius. One that has none within it is searched for again with twice the radius, until the radius covers everything,
    so the radius sets the cost and not the result. Without a template there is no row.
    """
    own = [c for c in objects.columns if c not in XYZ]
    ends = [f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    box = objects.select(*XYZ).union(templates.select(*XYZ)).agg(*ends).first()
    span = max(((box[f"hi{c}"] or 0.0) - (box[f"lo{c}"] or 0.0)) for c in XYZ)
    left, done = objects, None
    cells = F.explode(F.array(*[F.struct(*[F.lit(k).alias(f"d{c}") for c, k in zip(XYZ, o, strict=True)]) for o in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]]))
    while True:
        last = radius >= span  # then every template lies in the same cell or the next
        near = templates.select("global_id", F.struct(*XYZ).alias("t"), cells.alias("o"), *XYZ).select("global_id", "t", *[(F.floor(F.col(c) / radius) + F.col(f"o.d{c}")).alias(f"i{c}") for c in XYZ])
        met = left.select(*own, F.struct(*XYZ).alias("p"), *[F.floor(F.col(c) / radius).alias(f"i{c}") for c in XYZ]).join(near, [f"i{c}" for c in XYZ])
        met = met.withColumn("dist", _distance([F.col(f"p.{c}") for c in XYZ], [F.col(f"t.{c}") for c in XYZ]))
        best = (met if last else met.filter(F.col("dist") <= radius)).groupBy(*own).agg(F.min(F.struct("dist", "global_id")).alias("b")).select(*own, "b.global_id", "b.dist")
        best = cut(best)
        done = best if done is None else done.unionByName(best)
        if last:
            return done
        left = cut(left.join(best.select(*own), own, "left_anti"))
        if left.isEmpty():
            return done
        radius *= 2
