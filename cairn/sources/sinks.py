"""Sinks: point files, meshes, planes, summaries, and the debug views as tables of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

#: The colours of overlays as blue, green, red, in turn.
PALETTE = ((0, 255, 0), (0, 255, 255), (255, 0, 0), (255, 0, 255), (0, 128, 255), (255, 255, 0), (128, 0, 255), (255, 128, 0))

#: Colours of the parts of a split as red, green, blue, in turn; the line between them is red.
PARTS = ((0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (255, 128, 0), (128, 0, 255))
LINE = (255, 0, 0)


def ply_text(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value): each group's points as an ASCII PLY file. A group is one object."""
    byte = lambda c: F.format_string("%d", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))) * 255).cast("int"))
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"], *[byte(F.col(c)) for c in "rgb"])
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pid", line.alias("l")))).alias("p"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("p").cast("string"), F.lit("\n" + "".join(f"property double {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"))
    return rows.select(*keys, F.concat(head, F.array_join(F.col("p.l"), "\n")).alias("value"))


def write_ply(points: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One PLY file a group, in a folder named by its keys."""
    text = ply_text(points, keys)
    text.repartition(*keys).write.mode("overwrite").partitionBy(*keys).option("lineSep", "\n").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, keys: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Planes, masks, events, identities and clouds as Parquet, split by keys."""
    w = rows.write.mode(mode)
    (w.partitionBy(*keys) if keys else w).parquet(path)


def depth_view(pixels: DataFrame, keys: Sequence[str], depth: str = "depth_u16") -> DataFrame:
    """Pixels with `grey`: depth between the frame's least and greatest valid depth as 0 to 255."""
    ends = pixels.filter(F.col(depth) > 0).groupBy(*keys).agg(F.min(depth).alias("_lo"), F.max(depth).alias("_hi"))
    q = pixels.join(ends, list(keys), "left") if keys else pixels.join(F.broadcast(ends), how="left", on=F.lit(True))
    grey = (F.col(depth) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6) * 255
    return q.withColumn("grey", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(255.0), grey)).cast("int"), F.lit(0))).drop("_lo", "_hi")


def overlay(pixels: DataFrame, masks: DataFrame, keys: Sequence[str], alpha: float = 0.35) -> DataFrame:
    """Pixels r, g, b with the masks' colours blended over them, one after the other by mask_id from 1, each time truncated; `mask_id` is the last one's. masks: (keys, mask_id, u, v).

    Blending is in single precision, as an image's is. A pixel has at most as many entries as its frame has masks.
    """
    over = masks.groupBy(*keys, "u", "v").agg(F.array_sort(F.collect_list("mask_id")).alias("_over"))
    q = pixels.join(over, [*keys, "u", "v"], "left")
    single = lambda x: F.lit(x).cast("float")

    def blend(channel: str, i: int) -> Column:
        table = F.array(*[F.lit(float(c[i])).cast("float") for c in PALETTE])
        mixed = lambda x, m: F.floor(x * single(1 - alpha) + F.element_at(table, (F.pmod(m - 1, F.lit(len(PALETTE))) + 1).cast("int")) * single(alpha)).cast("float")
        return F.aggregate(F.coalesce("_over", F.array().cast("array<int>")), F.col(channel).cast("float"), mixed).cast("int").alias(channel)

    return q.select(*keys, "u", "v", blend("r", 2), blend("g", 1), blend("b", 0), F.array_max("_over").alias("mask_id"))


def mask_labels(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where each mask's number is written: its centroid, truncated."""
    return masks.groupBy(*keys, "mask_id").agg(F.avg("u").cast("int").alias("u"), F.avg("v").cast("int").alias("v"))


def projection_view(points: DataFrame, keys: Sequence[str], x: str, y: str, size: int = 512, margin: int = 20) -> DataFrame:
    """(keys, px, py, drawn): finite 2-D points fitted into a square image with a margin, y upwards. A point on the image's lower edge falls outside and isn't drawn."""
    sound = points.filter(" AND ".join(f"NOT isnan(`{c}`) AND abs(`{c}`) < double('Infinity')" for c in (x, y)))
    e = sound.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    q = sound.join(e, list(keys)) if keys else sound.join(F.broadcast(e))
    scale: Column = (size - 2 * margin) / F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-6))
    at = q.select(*keys, F.rint((F.col(x) - F.col("_x0")) * scale + margin).cast("int").alias("px"), F.rint(size - ((F.col(y) - F.col("_y0")) * scale + margin)).cast("int").alias("py"))
    return at.withColumn("drawn", F.expr(f"px >= 0 AND px < {size} AND py >= 0 AND py < {size}"))


def projection_frame(view: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, drawn, x0, y0, x1, y1): the rectangle about the points of projection_view(), and how many of them are drawn."""
    return view.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("drawn").alias("drawn"), F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))


def renumber(objects: DataFrame, frame: Sequence[str], order: str) -> DataFrame:
    """The objects that are left of each frame, numbered from 1."""
    from pyspark.sql import Window

    return objects.withColumn("local_id", F.row_number().over(Window.partitionBy(*frame).orderBy(order)))


def split_view(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, u, v, r, g, b): parts of a split in the colours of PARTS, the line between them (label -1) red, everything else black."""
    colour = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in PARTS]), (F.pmod(F.col("label") - 1, F.lit(len(PARTS))) + 1).cast("int"))
    pick = lambda i: F.when(F.col("label") == -1, LINE[i]).when(F.col("label") > 0, colour(i)).otherwise(0)
    return labels.select(*keys, "u", "v", *[pick(i).alias(c) for i, c in enumerate("rgb")])


def run_summary(status: DataFrame) -> DataFrame:
    """One JSON object `json` for a run: its frames, how many are ok, and how many ended in each stage status."""
    n = status.groupBy("stage_status").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("frames"), F.coalesce(F.sum(F.when(F.col("stage_status") == "ok", F.col("n"))), F.lit(0)).alias("ok"), F.array_sort(F.collect_list(F.struct(F.col("stage_status").alias("status"), "n"))).alias("statuses"))
    return whole.select(F.to_json(F.struct("*")).alias("json"))


def id_map(events: DataFrame) -> DataFrame:
    """(rec_id, keyframe_index, json): which identity each object of a keyframe got, in the order of the objects."""
    pairs = F.array_sort(F.collect_list(F.struct("local_id", "global_id")))
    return events.groupBy("rec_id", "keyframe_index").agg(F.to_json(pairs).alias("json"))


def track_points(points: DataFrame, events: DataFrame) -> DataFrame:
    """Object points (rec_id, keyframe_index, local_id, ...) with the identity that they count for."""
    return points.join(events.filter("global_id > 0").select("rec_id", "keyframe_index", "local_id", "global_id"), ["rec_id", "keyframe_index", "local_id"])


def accumulated(points: DataFrame, events: DataFrame, keyframes: DataFrame) -> DataFrame:
    """The cloud of every track as it is after each of the keyframes (rec_id, keyframe_index) that are asked for: `at` and the points until then.

    Keyframes of a recording are bounded by its source; ask for the last alone to get each track's latest cloud.
    """
    asked = keyframes.select("rec_id", F.col("keyframe_index").alias("at")).distinct()
    return track_points(points, events).join(asked, "rec_id").filter("keyframe_index <= at")


def state_summary(points: DataFrame, events: DataFrame) -> DataFrame:
    """(rec_id, global_id, ...): observations, last keyframe, points, median centre, extent and mean colour of every track, and its geometry where events have it."""
    ids = ["rec_id", "global_id"]
    p = track_points(points, events)
    own = stats.summary(p, ids).select(*ids, F.col("n").alias("points"), *[f"{k}{c}" for k in "ce" for c in "xyz"])
    seen = p.groupBy(*ids).agg(F.countDistinct("keyframe_index", "local_id").alias("obs_count"), F.max("keyframe_index").alias("last_seen"))
    out = own.join(stats.mean_colour(p, ids), ids).join(seen, ids)
    if "shape" not in events.columns:
        return out
    last = events.filter("global_id > 0").groupBy(*ids).agg(F.max_by(F.struct("shape", "confidence", "pending_count", "params"), "keyframe_index").alias("s"))
    return out.join(last, ids).select(*out.columns, "s.*")


def geometry_of(summary: DataFrame) -> DataFrame:
    """A state summary with the parameters of each track's geometry as columns."""
    p = F.from_json("params", "sx double, sy double, sz double, diameter double, radius double, height double")
    return summary.withColumn("_p", p).select(*summary.columns, "_p.*")


def write_keyframes(points: DataFrame, events: DataFrame, path: str) -> None:
    """A folder for each recording and keyframe: identities, the tracks' clouds so far, and their meshes by the geometry of that keyframe."""
    from ..operators import objects

    at = ["rec_id", "keyframe_index"]
    write_table(id_map(events), f"{path}/id_map", at)
    write_table(accumulated(points, events, events).withColumnRenamed("at", "snapshot"), f"{path}/tracks", ["rec_id", "snapshot"])
    write_table(events, f"{path}/events", at)
    shaped = geometry_of(events.filter("global_id > 0 AND params IS NOT NULL").select(*at, "global_id", "shape", "params"))
    write_table(objects.meshes(shaped, [*at, "global_id"]), f"{path}/meshes", at)


def write_final(points: DataFrame, events: DataFrame, fused: DataFrame, path: str) -> None:
    """What is left of a run: the state summary, every identity's fused cloud as PLY and Parquet, and its mesh."""
    from ..operators import objects

    ids = ["rec_id", "global_id"]
    summary = state_summary(points, events)
    write_json(summary, f"{path}/summary")
    write_table(fused, f"{path}/clouds", ids)
    write_ply(fused.withColumn("pid", F.xxhash64(*[c for c in fused.columns if c not in ids])), f"{path}/ply", ids)
    write_table(objects.meshes(geometry_of(summary.filter("params IS NOT NULL")), ids), f"{path}/meshes", ids)


def foreach_keyframe(path: str):
    """A foreachBatch function that appends events and keeps the last state of every track, one folder a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        last = batch.filter("global_id > 0").groupBy("rec_id", "global_id").agg(F.max_by(F.struct("keyframe_index", "event", "obs_count", "points", "shape", "confidence"), "keyframe_index").alias("s"))
        last.select("rec_id", "global_id", "s.*").write.mode("overwrite").parquet(f"{path}/latest/batch={batch_id}")

    return write
