"""The keyframe pipeline: from depth pixels to masks and clouds of the objects on a table, for all frames at once.

Frames have a number `fid`; pixels are (fid, u, v, depth_u16, r, g, b). There is no loop over frames: each stage is one plan
over all of them. A stage that fails for a frame gives it a `stage_status`, apart from the status of its plane fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FusionConfig, MaskConfig, SplitConfig, TableConfig
from ..functions.exprs import XYZ, back_project, project_round, project_trunc
from ..functions.split import Camera
from ..operators import cloud, objects, raster, watershed
from .lineage import cut

FID = ["fid"]


@dataclass
class Segmented:
    """What segmentation gives: planes, table masks and the bare table in them, object masks (fid, local_id, u, v), object points, and a status for every frame."""

    planes: DataFrame
    table: DataFrame
    table_only: DataFrame
    masks: DataFrame
    points: DataFrame
    status: DataFrame


def signed_height() -> Column:
    """Signed distance of a point to its frame's plane."""
    return F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d")


def oriented(planes: DataFrame, xyz: DataFrame, table: DataFrame, cfg: MaskConfig) -> DataFrame:
    """Planes whose normal points to the side that has more pixels of the table mask in the height range of objects; it turns only for strictly more."""
    h = xyz.join(table, ["fid", "u", "v"], "left_semi").join(planes, FID).withColumn("_s", signed_height())
    n = h.groupBy("fid").agg(F.count_if(F.col("_s").between(cfg.clearance, cfg.max_distance)).alias("_up"), F.count_if((-F.col("_s")).between(cfg.clearance, cfg.max_distance)).alias("_down"))
    side = F.when(F.col("_down") > F.col("_up"), F.lit(-1.0)).otherwise(F.lit(1.0))
    q = planes.join(n, FID, "left").withColumn("_side", side)
    return q.withColumns({c: F.col(c) * F.col("_side") for c in ("nx", "ny", "nz", "d")}).drop("_up", "_down", "_side")


def table_masks(xyz: DataFrame, planes: DataFrame, k: Sequence[float], h: int, w: int, cfg: MaskConfig) -> DataFrame:
    """Pixels of the table: those in the plane's band, closed, dilated, with holes filled; the largest part if it is large enough."""
    band = xyz.filter("z > 1e-6").join(planes, FID).filter(F.abs(signed_height()) <= cfg.band)
    seen = project_trunc(band.select("fid", *XYZ), k, h, w).select("fid", "u", "v").distinct()
    m = raster.dilate(raster.close(seen, FID, raster.ellipse(cfg.close), h, w), FID, raster.ellipse(cfg.dilate), h, w)
    m = raster.fill_holes(cut(m), h, w, "fid")
    parts = raster.pixel_components(m, FID, w, frame=F.col("fid"), h=h)
    return raster.keep_largest(parts, FID, cfg.table_min_area).select("fid", "u", "v")


def table_only(xyz: DataFrame, table: DataFrame, planes: DataFrame, cfg: MaskConfig) -> DataFrame:
    """Pixels of the table mask that lie in the plane's band: the table without what stands on it."""
    on = xyz.filter("z > 1e-6").join(table, ["fid", "u", "v"], "left_semi").join(planes, FID)
    return on.filter(F.abs(signed_height()) <= cfg.band).select("fid", "u", "v")


def object_mask(mask: DataFrame, ids: Sequence[str], h: int, w: int, cfg: MaskConfig) -> DataFrame:
    """Masks of single objects closed, with their holes filled, and dilated. ids: fid first, then what tells the masks of a frame apart."""
    m = raster.close(mask, ids, raster.ellipse(cfg.object_close), h, w) if cfg.object_close > 1 else mask
    rank = F.row_number().over(Window.partitionBy(ids[0]).orderBy(*ids[1:]))
    numbers = cut(mask.select(*ids).distinct().withColumn("_n", F.col(ids[0]).cast("long") * 65536 + rank))
    m = raster.fill_holes(cut(m.join(numbers, list(ids)).select("_n", "u", "v")), h, w, "_n").join(numbers, "_n").select(*ids, "u", "v")
    return raster.dilate(m, ids, raster.ellipse(cfg.object_dilate), h, w) if cfg.object_dilate > 1 else m


def object_pixels(xyz: DataFrame, table: DataFrame, planes: DataFrame, h: int, w: int, cfg: MaskConfig) -> DataFrame:
    """Pixels of objects: in the eroded table mask, at a height over the table, opened, closed, without specks."""
    inner = raster.erode(table, FID, raster.ellipse(cfg.table_erode), h, w)
    up = xyz.filter("z > 1e-6").join(inner, ["fid", "u", "v"], "left_semi").join(planes, FID)
    m = up.filter(signed_height().between(cfg.clearance, cfg.max_distance)).select("fid", "u", "v")
    m = raster.close(raster.open_(m, FID, raster.ellipse(cfg.open_objects), h, w), FID, raster.ellipse(cfg.close_objects), h, w)
    if cfg.dilate_objects > 1:
        m = raster.dilate(m, FID, raster.ellipse(cfg.dilate_objects), h, w)
    parts = raster.pixel_components(cut(m), FID, w, frame=F.col("fid"), h=h)
    return raster.remove_small(parts, FID, cfg.min_component_area).select("fid", "u", "v")


def segment(pixels: DataFrame, k: Sequence[float], h: int, w: int, scale: float = 0.001, table: TableConfig | None = None, cfg: MaskConfig | None = None) -> Segmented:
    """Objects on the table of every frame: plane, masks, clusters, checks of extent, area and support, and clouds."""
    table, cfg = table or TableConfig(), cfg or MaskConfig()
    xyz = cut(back_project(pixels, k, scale, keep_invalid=True).withColumn("pid", F.col("fid").cast("long") * (h * w) + F.col("v") * w + F.col("u")))
    valid = xyz.filter("z > 1e-6").select("fid", "pid", *XYZ)
    thin = cut(cloud.preprocess(valid, FID, table.voxel, table.remove_outliers, table.neighbours, table.std_ratio))
    raw = valid.groupBy("fid").agg(F.count("*").alias("raw"))
    planes = cut(cloud.fit_planes(thin, "fid", table.distance, table.iterations, table.min_inlier_ratio, up=table.up, max_angle_deg=table.max_angle_deg, raw=raw))
    good = planes.filter("status = 'ok'").select("fid", "nx", "ny", "nz", "d")
    on_table = cut(table_masks(xyz, good, k, h, w, cfg))
    good = cut(oriented(good, xyz.filter("z > 1e-6"), on_table, cfg))
    above = cut(object_pixels(xyz, on_table, good, h, w, cfg))
    cloud_px = xyz.join(above, ["fid", "u", "v"], "left_semi")
    label = cut(cloud.dbscan(cloud_px.select("fid", "pid", *XYZ), cfg.eps, cfg.min_samples, FID).filter("label IS NOT NULL"))
    clustered = cloud_px.join(label.select("pid", "label"), "pid").join(good, FID).withColumn("height", signed_height())
    size = clustered.groupBy("fid", "label").agg(
        F.count("*").alias("n"), F.greatest(*[F.max(c) - F.min(c) for c in XYZ]).alias("e"), (F.max("height") - F.min("height")).alias("he"), F.percentile("height", F.lit(0.5)).alias("hm"),
    )
    fits = size.filter((F.col("n") >= cfg.min_cluster_points) & F.col("e").between(cfg.min_extent, cfg.max_extent) & (F.col("he") <= cfg.max_height_extent) & (F.col("hm") >= cfg.min_median_height))
    kept = clustered.join(fits.select("fid", "label"), ["fid", "label"], "left_semi")
    mask = _parts_of(cut(kept), pixels, k, h, w, cfg)
    ids = ["fid", "label", "part"]
    stands = _supported(mask, xyz, on_table, good, h, w, cfg)
    points = mask.join(stands, ids, "left_semi").join(above, ["fid", "u", "v"], "left_semi").join(xyz.filter("z > 1e-6"), ["fid", "u", "v"])
    enough = points.groupBy(*ids).count().filter(F.col("count") >= cfg.min_final_points)
    numbered = enough.select(*ids, F.row_number().over(Window.partitionBy("fid").orderBy(F.desc("count"), "label", "part")).alias("local_id"))
    points = points.join(numbered, ids).select("fid", "local_id", "pid", "u", "v", *XYZ, *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    masks = mask.join(numbered, ids).select("fid", "local_id", "u", "v")
    has = lambda df: df.select("fid").distinct()
    status = planes.select("fid", F.col("status").alias("plane_status"), "inlier_ratio")
    for name, df in (("_t", on_table), ("_a", above), ("_c", label.join(cloud_px.select("pid", "fid"), "pid")), ("_o", numbered)):
        status = status.join(has(df).withColumn(name, F.lit(1)), FID, "left")
    stage = F.when(F.col("plane_status") != "ok", "fail_table_seg").when(F.col("_t").isNull(), "fail_table_component").when(F.col("_a").isNull(), "no_object_pixels_on_table").when(F.col("_c").isNull(), "no_clusters").when(F.col("_o").isNull(), "no_objects").otherwise("ok")
    return Segmented(good, on_table, table_only(xyz, on_table, good, cfg), masks, points, status.select("fid", "plane_status", "inlier_ratio", stage.alias("stage_status")))


def _parts_of(kept: DataFrame, pixels: DataFrame, k: Sequence[float], h: int, w: int, cfg: MaskConfig) -> DataFrame:
    """(fid, label, part, u, v): the masks of clusters, made from their points' pixels; what may be several objects is cut by the watershed of its mask.

    A cluster's mask is completed and must be large enough before it is looked at; each part of it is completed again and must be large enough too.
    """
    keys, ids = ["fid", "label"], ["fid", "label", "part"]
    seen = project_trunc(kept.select(*keys, *XYZ), k, h, w).select(*keys, "u", "v").distinct()
    mask = object_mask(seen, keys, h, w, cfg)
    large = mask.groupBy(*keys).agg(F.count("*").alias("area"), *[f(c).alias(f"{n}_{c}") for c in ("u", "v") for n, f in (("min", F.min), ("max", F.max))]).filter(F.col("area") >= cfg.min_object_area)
    mask = cut(mask.join(large.select(*keys), keys, "left_semi"))
    sized = large.join(kept.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    suspect = cloud.merged_candidates(sized, keys, cfg.merged_points, cfg.merged_area, cfg.merged_side).filter("suspicious").select(*keys)
    rgb = mask.join(suspect, keys, "left_semi").join(pixels.select("fid", "u", "v", "r", "g", "b"), ["fid", "u", "v"])
    cutup = watershed.watershed_split(rgb.select(*keys, "u", "v", "r", "g", "b"), keys, h, w, cfg.peak_ratio, cfg.min_peak_area)
    whole = mask.join(suspect, keys, "left_anti").select(*keys, F.lit(1).alias("part"), "u", "v")
    parts = cut(whole.unionByName(cutup.select(*keys, "part", "u", "v")))
    done = object_mask(parts, ids, h, w, cfg)
    enough = done.groupBy(*ids).count().filter(F.col("count") >= cfg.min_object_area).select(*ids)
    return cut(done.join(enough, ids, "left_semi"))


def _supported(mask: DataFrame, xyz: DataFrame, table: DataFrame, planes: DataFrame, h: int, w: int, cfg: MaskConfig) -> DataFrame:
    """Keys of the masks that stand on the table."""
    ids = ["fid", "label", "part"]
    px = mask.join(xyz.select("fid", "u", "v", *XYZ), ["fid", "u", "v"], "left").join(planes, FID)
    px = px.withColumn("height", F.when(F.col("z") > 1e-6, signed_height())).join(table.withColumn("_on", F.lit(True)), ["fid", "u", "v"], "left")
    px = px.select(*ids, "u", "v", "height", F.coalesce("_on", F.lit(False)).alias("on_table"))
    return raster.support(px, ids, h, w, cfg.bottom_band, cfg.min_bottom_pixels, cfg.min_inside_ratio, cfg.edge_margin, cfg.edge_min_inside_ratio).filter("reason IS NULL").select(*ids)


def refine(seg: Segmented, pixels: DataFrame, k: Sequence[float], h: int, w: int, scale: float = 0.001, cfg: SplitConfig | None = None, with_depth: bool = True) -> DataFrame:
    """(fid, local_id, part, mode, x, y, z): the objects of every frame cleaned and split where they are several."""
    depth = None
    if with_depth:
        from ..functions.exprs import depth_metres, valid_depth

        depth = raster.smooth(pixels.select("fid", "u", "v", valid_depth(depth_metres("depth_u16", scale=scale)).alias("depth")), FID)
    return objects.refine(seg.points.select("fid", "local_id", "pid", *XYZ, "r", "g", "b"), seg.masks, depth, ["fid", "local_id"], FID, Camera(tuple(k), h, w), cfg)


def to_reference(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Object points in the camera frame of their recording's first keyframe. frames: fid, rec_id, keyframe_index, t_wc."""
    from ..functions.exprs import inverse_rigid, rigid

    first = frames.groupBy("rec_id").agg(F.min_by("t_wc", "keyframe_index").alias("t0")).withColumn("t_c0w", inverse_rigid("t0")).drop("t0")
    q = points.join(frames.select("fid", "rec_id", "keyframe_index", "t_wc"), FID).join(first, "rec_id")
    return rigid(rigid(q, "t_wc"), "t_c0w").drop("t_wc", "t_c0w")


def fuse(points: DataFrame, events: DataFrame, cfg: FusionConfig | None = None) -> DataFrame:
    """(rec_id, global_id, x, y, z, r, g, b): the clouds of every identity together, cleaned. events: global_id by rec_id, keyframe_index, local_id."""
    cfg, ids = cfg or FusionConfig(), ["rec_id", "global_id"]
    named = points.join(events.filter("global_id > 0").select("rec_id", "keyframe_index", "local_id", "global_id"), ["rec_id", "keyframe_index", "local_id"])
    thin = cloud.voxel_mean(named, ids, cfg.voxel, extra=("r", "g", "b"))
    order = F.row_number().over(Window.partitionBy(*ids).orderBy("ix", "iy", "iz"))
    thin = thin.withColumn("pid", order.cast("long")).select(*ids, "pid", *XYZ, "r", "g", "b")
    return objects.denoise(thin, ids, "large", voxel=0.0, k=cfg.neighbours, std_ratio=cfg.std_ratio, ratio=cfg.keep_cluster_ratio, eps=cfg.eps, least=cfg.min_samples)


def projected_masks(points: DataFrame, keys: Sequence[str], k: Sequence[float], h: int, w: int, size: int = 5) -> DataFrame:
    """(keys, u, v): the masks of clouds: their pixels, rounded half to even, dilated and closed by a square."""
    seen = project_round(points, k, h, w).filter("inside").select(*keys, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v")).distinct()
    if size <= 1:
        return seen
    kernel = raster.square(size)
    return raster.close(raster.dilate(seen, keys, kernel, h, w), keys, kernel, h, w)


def refined_objects(seg: Segmented, refined: DataFrame) -> DataFrame:
    """The objects that refinement left, as points of frames numbered anew: larger objects first, parts of one after the other."""
    order = Window.partitionBy("fid").orderBy("local_id", "part")
    number = refined.select("fid", "local_id", "part").distinct().withColumn("_new", F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy("fid", "local_id").orderBy(*XYZ)).cast("long")
    return refined.join(number, ["fid", "local_id", "part"]).select("fid", F.col("_new").alias("local_id"), *XYZ, "r", "g", "b").withColumn("pid", place)


def run(pixels: DataFrame, frames: DataFrame, k: Sequence[float], h: int, w: int, scale: float = 0.001, table: TableConfig | None = None, mask: MaskConfig | None = None, split: SplitConfig | None = None, fixed: bool = True, with_depth: bool = True) -> tuple[Segmented, DataFrame, DataFrame]:
    """The whole pipeline of recordings: segmentation, refinement of the objects, tracks (events), fused clouds."""
    from ..streaming.tracks import observations_of, track_batch

    seg = segment(pixels, k, h, w, scale, table, mask)
    left = refined_objects(seg, cut(refine(seg, pixels, k, h, w, scale, split, with_depth)))
    camera = cut(left.join(frames.select("fid", "rec_id", "keyframe_index"), FID))
    points = cut(to_reference(left, frames))
    masks = projected_masks(camera, ["rec_id", "keyframe_index", "local_id"], k, h, w)
    events = cut(track_batch(observations_of(points, camera, masks), fixed=fixed))
    return seg, events, fuse(points, events)
