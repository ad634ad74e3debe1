"""Operators on whole objects: grouped kernels. A group is one object of one frame or one fused, voxel-thinned object, which bounds it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SplitConfig
from ..functions import kernels, shapes, split
from ..functions.exprs import XYZ, finite
from ..functions.stats import robust_trim
from ..plans.lineage import cut
from . import cloud, outline


def _with(df: DataFrame, keys: Sequence[str], ddl: str) -> str:
    return ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [ddl])


def thinned(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finite points, trimmed, and thinned to the first point of each voxel of a size that suits the object: at most some 80 cells a side."""
    trimmed = robust_trim(points.filter(finite()), keys)
    q = trimmed.join(cloud.voxel_size(trimmed, keys), list(keys))
    cells = [F.floor(F.col(c) / F.col("edge")).alias(f"i{c}") for c in XYZ]
    first = q.groupBy(*keys, *cells).agg(F.min_by(F.struct("pid", *XYZ), "pid").alias("p"))
    return first.select(*keys, "p.pid", *[f"p.{c}" for c in XYZ])


def infer_geometry(points: DataFrame, previous: DataFrame | None, keys: Sequence[str], least: int = 180) -> DataFrame:
    """The geometry of every object: its points against its previous geometry (columns of shapes.GEOMETRY), a box of low confidence if it has none."""
    q = thinned(points, keys)
    if previous is not None:
        q = q.join(previous.select(*keys, F.col("shape").alias("_shape"), F.col("allow_upgrade").alias("_up")), list(keys), "left")
    else:
        q = q.withColumns({"_shape": F.lit("box"), "_up": F.lit(True)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        shape, up = pdf["_shape"].iloc[0], pdf["_up"].iloc[0]
        before = {"shape": shape or "box", "confidence": "low", "allow_upgrade": bool(up) if up is not None else True, "allow_downgrade": shape not in (None, "box"), "params": {}}
        p = pdf[list(XYZ)].to_numpy(float)
        got = shapes.infer(p, before, least)
        row = {k: pdf[k].iloc[0] for k in keys} | shapes.pack(got) | {"score": got.get("score"), "points": len(p)}
        return pd.DataFrame([row])

    return q.groupBy(*keys).applyInPandas(run, _with(points, keys, f"{shapes.GEOMETRY}, score double, points long"))


def initial_geometry(points: DataFrame, keys: Sequence[str], masks: DataFrame | None = None) -> DataFrame:
    """A cautious first geometry of every object; masks (keys, u, v) add the outline of its pixels."""

    def fit(p: np.ndarray, mask: np.ndarray | None, row: dict) -> pd.DataFrame:
        return pd.DataFrame([row | shapes.pack(shapes.initial(p, mask))])

    schema = _with(points, keys, shapes.GEOMETRY)
    if masks is None:
        return points.groupBy(*keys).applyInPandas(lambda pdf: fit(pdf.sort_values("pid")[list(XYZ)].to_numpy(float), None, {k: pdf[k].iloc[0] for k in keys}), schema)

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=[x.split()[0].strip("`") for x in schema.split(", ")])
        return fit(a.sort_values("pid")[list(XYZ)].to_numpy(float), image_of(b), {k: a[k].iloc[0] for k in keys})

    return points.groupBy(*keys).cogroup(masks.groupBy(*keys)).applyInPandas(both, schema)


def image_of(pixels: pd.DataFrame, h: int | None = None, w: int | None = None) -> np.ndarray:
    """The mask of pixel rows as an image; a margin of 1 about them unless a size is given."""
    if h is None:
        if not len(pixels):
            return np.zeros((0, 0), bool)
        u, v = pixels["u"] - pixels["u"].min() + 1, pixels["v"] - pixels["v"].min() + 1
        h, w = int(v.max()) + 2, int(u.max()) + 2
    else:
        u, v = pixels["u"], pixels["v"]
    out = np.zeros((h, w), bool)
    out[v.to_numpy(int), u.to_numpy(int)] = True
    return out


def mask_features(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outline features of every mask."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | kernels.contour_features(image_of(pdf))])

    return masks.groupBy(*keys).applyInPandas(run, _with(masks, keys, "valid boolean, circularity double, aspect_ratio double, corners int, rectangularity double, line_support double"))


def rectangle_fits(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """The rotated rectangle of every object's 2-D points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | kernels.rectangle_fit(pdf[[x, y]].to_numpy(float))])

    return points.groupBy(*keys).applyInPandas(run, _with(points, keys, "valid boolean, iou double, score double, nrmse double, w double, h double, angle double"))


def projection_features(points: DataFrame, keys: Sequence[str], resolution: float = 0.003, votes: int = outline.VOTES) -> DataFrame:
    """(keys, view, valid, circularity, rectangularity, line_support, pca_ratio) of the three coordinate projections xy, xz, yz of every object.

    pca_ratio is that of the projection's principal variances, 999 with fewer than 10 finite points; the rest is of its occupancy image's outline and
    lines, and 0 where there is none.
    """
    views = F.explode(F.array(*[F.struct(F.lit(a + b).alias("view"), F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y")) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))]))
    flat = points.select(*keys, views.alias("p")).select(*keys, "p.*")
    own = [*keys, "view"]
    sound = F.when(~F.isnan("_x") & ~F.isnan("_y") & (F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")), True)
    c = flat.groupBy(*own).agg(F.count(sound).alias("_n"), *[F.covar_samp(F.when(sound, F.col(a)), F.when(sound, F.col(b))).alias(n) for n, a, b in (("_xx", "_x", "_x"), ("_xy", "_x", "_y"), ("_yy", "_y", "_y"))])
    half, root = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt((F.col("_xx") - F.col("_yy")) * (F.col("_xx") - F.col("_yy")) / 4 + F.col("_xy") * F.col("_xy"))
    ratio = F.when(F.col("_n") >= 10, (half + root) / F.greatest(half - root, F.lit(1e-6))).otherwise(999.0)
    image = cut(rasterised(flat, own, "_x", "_y", 3, 2048, False, resolution))
    seen = outline.features(image, own, votes)
    none = {"valid": F.lit(False)} | {n: F.lit(0.0) for n in ("circularity", "rectangularity", "line_support")}
    return c.select(*own, ratio.alias("pca_ratio")).join(seen, own, "left").select(*own, *[F.coalesce(n, v).alias(n) for n, v in none.items()], "pca_ratio")


def rasterised(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", pad: int = 3, most: int = 2048, disc: bool = False, resolution: float = 0.003) -> DataFrame:
    """(keys, u, v): the occupancy image of every object's 2-D points; none for fewer than 10 points or a side over `most`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = kernels.rasterise(pdf[[x, y]].to_numpy(float), pad, most, disc, resolution)
        v, u = np.nonzero(image) if image is not None else (np.zeros(0, int),) * 2
        return pd.DataFrame({"u": u, "v": v}).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "u", "v"]]

    return points.groupBy(*keys).applyInPandas(run, _with(points, keys, "u int, v int"))


def view_labels(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Circle or rectangle for the three views of every object's principal frame, and the shape that they speak for."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pid")[list(XYZ)].to_numpy(float)
        if len(p) < 10:
            return pd.DataFrame(columns=[*keys, "view", "label", "circle", "rectangle", "prior", "prior_confidence"])
        q, _, _, _ = shapes.pca_frame(p)
        views = {k: shapes.view_of(q[:, ij]) for k, ij in shapes.VIEWS.items()}
        prior = shapes.prior_of(q, views)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"view": n, "label": v["label"], "circle": v["circle"], "rectangle": v["rectangle"], "prior": prior["shape"], "prior_confidence": prior["confidence"]} for n, v in views.items()])

    return points.groupBy(*keys).applyInPandas(run, _with(points, keys, "view string, label string, circle double, rectangle double, prior string, prior_confidence string"))


def _columns(points: DataFrame) -> list[str]:
    """Coordinates, and colours where the points have them."""
    return [*XYZ, *(c for c in ("r", "g", "b") if c in points.columns)]


def refine(points: DataFrame, masks: DataFrame, depth: DataFrame | None, keys: Sequence[str], frame: Sequence[str], camera: split.Camera, cfg: SplitConfig | None = None, edges: bool = True) -> DataFrame:
    """(keys, part, mode, x, y, z and, if points have them, r, g, b): every object cleaned and, where that pays, split in two or more.

    masks: (keys, u, v); depth: (frame, u, v, depth in metres) or None. The depth of a frame reaches each of its objects within its mask's box.
    """
    cfg, own = cfg or SplitConfig(), _columns(points)
    near = masks.withColumn("_m", F.lit(1))
    if depth is not None:
        box = masks.groupBy(*keys).agg(F.min("u").alias("_u0"), F.max("u").alias("_u1"), F.min("v").alias("_v0"), F.max("v").alias("_v1"))
        around = box.join(depth.select(*frame, "u", "v", "depth"), list(frame)).filter("u BETWEEN _u0 - 8 AND _u1 + 8 AND v BETWEEN _v0 - 8 AND _v1 + 8")
        near = around.select(*keys, "u", "v", "depth").join(near, [*keys, "u", "v"], "full")
    else:
        near = near.withColumn("depth", F.lit(None).cast("double"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "part", "mode", *own]
        if not len(a):
            return pd.DataFrame(columns=names)
        mask = image_of(b[b["_m"] == 1], camera.h, camera.w)
        image = None
        if b["depth"].notna().any():
            image = np.zeros((camera.h, camera.w))
            seen = b[b["depth"].notna()]
            image[seen["v"].to_numpy(int), seen["u"].to_numpy(int)] = seen["depth"].to_numpy(float)
        out = []
        for i, (q, mode) in enumerate(split.refine(a.sort_values("pid")[own].to_numpy(float), mask, camera, cfg, image, edges)):
            part = pd.DataFrame(q, columns=own).assign(part=i + 1, mode=mode)
            out.append(part.assign(**{k: a[k].iloc[0] for k in keys}))
        return pd.concat(out)[names]

    schema = _with(points, keys, "part int, mode string, " + ", ".join(f"{c} double" for c in own))
    return points.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(run, schema)


def denoise(points: DataFrame, keys: Sequence[str], keep: str = "large", **options) -> DataFrame:
    """(keys, x, y, z and, if points have them, r, g, b): clouds as voxel means without outliers and without clusters that are small beside the largest."""
    own = _columns(points)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = split.denoise(pdf.sort_values("pid")[own].to_numpy(float), keep=keep, **options)
        return pd.DataFrame(q, columns=own).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, *own]]

    return points.groupBy(*keys).applyInPandas(run, _with(points, keys, ", ".join(f"{c} double" for c in own)))


def debug_refine(points: DataFrame, masks: DataFrame, depth: DataFrame | None, keys: Sequence[str], frame: Sequence[str], camera: split.Camera, one: dict, cfg: SplitConfig | None = None) -> DataFrame:
    """refine() of the one object whose keys have the given values; its depth parts clusters, but the depth's gradient has no say."""

    def same(df: DataFrame) -> DataFrame:
        for k, v in one.items():
            df = df.filter(F.col(f"`{k}`") == F.lit(v))
        return df

    return refine(same(points), same(masks), depth, keys, frame, camera, cfg, edges=False)


def meshes(geometries: DataFrame, keys: Sequence[str], inflate: float = 1.05) -> DataFrame:
    """(keys, kind, i, a, b, c): vertices and faces of every geometry that has the parameters its shape needs.

    inflate: 1.10 is meant for first geometries, 1.05 for later ones.
    """
    columns = ["shape", "sx", "sy", "sz", "diameter", "radius", "height"]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                params = {c: row[c] for c in columns[1:] if row[c] is not None and row[c] == row[c]}
                try:
                    v, f = shapes.mesh({"shape": row["shape"], "params": params}, inflate)
                except (KeyError, ValueError):
                    continue
                for kind, table in (("vertex", v), ("face", f)):
                    out.append(pd.DataFrame(table.astype(float), columns=["a", "b", "c"]).assign(kind=kind, i=range(len(table)), **{k: row[k] for k in keys}))
            if out:
                yield pd.concat(out)[[*keys, "kind", "i", "a", "b", "c"]]

    return geometries.select(*keys, *columns).mapInPandas(run, _with(geometries, keys, "kind string, i long, a double, b double, c double"))
