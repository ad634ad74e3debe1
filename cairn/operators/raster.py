"""Operators on rasters, held as rows: an image is keyed by frame columns and u, v; a mask is the set of its foreground pixels.

A stencil is an equi-join: every pixel is sent to its neighbours by the kernel's fixed list of offsets, and what arrives at a pixel
is aggregated. Pixels outside the image never arrive; kernels are small constants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

UV = ("u", "v")


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element of odd size, centre included."""
    r = size // 2
    out = []
    for dv in range(-r, r + 1):
        reach = round(r * (1 - (dv / r) ** 2) ** 0.5) if r else 0
        out += [(du, dv) for du in range(-reach, reach + 1)]
    return out


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(du, dv) for dv in range(-r, r + 1) for du in range(-r, r + 1)]


def grid(spark, h: int, w: int) -> DataFrame:
    """All pixels of an image."""
    return spark.range(h * w).select((F.col("id") % w).cast("int").alias("u"), F.expr(f"CAST(id DIV {w} AS INT)").alias("v"))


def _offsets(kernel: Sequence[tuple], names: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, names, strict=True)]) for o in kernel]))


def dilate(mask: DataFrame, keys: Sequence[str], kernel: Sequence[tuple[int, int]], h: int, w: int) -> DataFrame:
    """Pixels that the kernel about a foreground pixel covers."""
    moved = mask.select(*keys, *UV, _offsets(kernel, ("du", "dv")).alias("o"))
    moved = moved.select(*keys, (F.col("u") + F.col("o.du")).cast("int").alias("u"), (F.col("v") + F.col("o.dv")).cast("int").alias("v"))
    return moved.filter(f"u >= 0 AND u < {w} AND v >= 0 AND v < {h}").distinct()


def erode(mask: DataFrame, keys: Sequence[str], kernel: Sequence[tuple[int, int]], h: int, w: int) -> DataFrame:
    """Pixels whose whole kernel, as far as it lies in the image, is foreground."""
    moved = mask.select(*keys, *UV, _offsets(kernel, ("du", "dv")).alias("o"))
    moved = moved.select(*keys, (F.col("u") - F.col("o.du")).cast("int").alias("u"), (F.col("v") - F.col("o.dv")).cast("int").alias("v"))
    hits = moved.filter(f"u >= 0 AND u < {w} AND v >= 0 AND v < {h}").groupBy(*keys, *UV).agg(F.count("*").alias("_n"))
    inside = sum((F.expr(f"CAST(u + {du} BETWEEN 0 AND {w - 1} AND v + {dv} BETWEEN 0 AND {h - 1} AS INT)") for du, dv in kernel), F.lit(0))
    return hits.filter(F.col("_n") == inside).drop("_n").join(mask.select(*keys, *UV), [*keys, *UV], "left_semi") if (0, 0) in kernel else hits.filter(F.col("_n") == inside).drop("_n")


def close(mask: DataFrame, keys: Sequence[str], kernel: Sequence[tuple[int, int]], h: int, w: int) -> DataFrame:
    return erode(dilate(mask, keys, kernel, h, w), keys, kernel, h, w)


def open_(mask: DataFrame, keys: Sequence[str], kernel: Sequence[tuple[int, int]], h: int, w: int) -> DataFrame:
    return dilate(erode(mask, keys, kernel, h, w), keys, kernel, h, w)


def band(a: DataFrame, b: DataFrame, keys: Sequence[str], h: int, w: int, size: int = 7) -> DataFrame:
    """Where two masks meet: the intersection of both, dilated by a square of odd size."""
    k = square(size | 1)
    return dilate(a, keys, k, h, w).join(dilate(b, keys, k, h, w), [*keys, *UV], "left_semi")


def complement(mask: DataFrame, h: int, w: int, keys: Sequence[str] = (), frames: DataFrame | None = None) -> DataFrame:
    """The background of a mask; with keys, of the mask of every frame of `frames` (by default those that have a mask pixel)."""
    if not keys:
        return grid(mask.sparkSession, h, w).join(mask.select(*UV), list(UV), "left_anti")
    frames = (frames if frames is not None else mask).select(*keys).distinct()
    every = frames.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))))
    every = every.select(*keys, (F.col("_i") % w).cast("int").alias("u"), F.expr(f"CAST(_i DIV {w} AS INT)").alias("v"))
    return every.join(mask.select(*keys, *UV), [*keys, *UV], "left_anti")


def pixel_components(mask: DataFrame, keys: Sequence[str], w: int, neighbours: int = 8, depth: str | None = None, step: float = 0.01, frame: Column | None = None, h: int = 4096) -> DataFrame:
    """(keys, u, v, label): connected parts of the masks; label is the least pixel number v * w + u (of the frame's own range).

    With a depth column pixels are linked only if their depths differ by at most step. frame is a number of the frame, 0 if there is one only.
    """
    base = (frame if frame is not None else F.lit(0)).cast("long") * (h * w)
    p = mask.withColumn("id", base + F.col("v") * F.lit(w).cast("long") + F.col("u"))
    half = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if neighbours == 8 else [])
    to = p.select(*keys, F.col("id").alias("a"), *([F.col(depth).alias("_da")] if depth else []), *UV, _offsets(half, ("du", "dv")).alias("o"))
    to = to.select(*keys, "a", *(["_da"] if depth else []), (F.col("u") + F.col("o.du")).alias("u"), (F.col("v") + F.col("o.dv")).alias("v"))
    edges = to.join(p.select(*keys, *UV, F.col("id").alias("b"), *([F.col(depth).alias("_db")] if depth else [])), [*keys, *UV])
    if depth:
        edges = edges.filter(F.abs(F.col("_da") - F.col("_db")) <= step)
    label = components(p.select("id"), edges.select("a", "b"))
    return p.join(label, "id").drop("id")


def areas(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, area, cu, cv): size and centroid of every part."""
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("area"), F.avg("u").alias("cu"), F.avg("v").alias("cv"))


def remove_small(labels: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Pixels of parts of `least` pixels or more."""
    keep = areas(labels, keys).filter(F.col("area") >= least).select(*keys, "label")
    return labels.join(keep, [*keys, "label"], "left_semi")


def keep_largest(labels: DataFrame, keys: Sequence[str], least: int = 0) -> DataFrame:
    """Pixels of the largest part of each group, the first among equals; none if it has fewer than `least`."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), "label"))
    keep = areas(labels, keys).withColumn("_r", first).filter(f"_r = 1 AND area >= {least}").select(*keys, "label")
    return labels.join(keep, [*keys, "label"], "left_semi")


def largest_ratio(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: number of parts and the share of all pixels that the largest one has."""
    return areas(labels, keys).groupBy(*keys).agg(F.count("*").alias("parts"), (F.max("area") / F.sum("area")).alias("ratio"))


def fill_holes(mask: DataFrame, h: int, w: int, key: str | None = None) -> DataFrame:
    """A mask with every background pixel that pixel (0, 0) can't reach over 4 neighbours; with a key (a frame's number), of every frame.

    If (0, 0) is foreground there is no outside to start from, and the mask stays as it is.
    """
    keys = [key] if key else ["_k"]
    m = mask if key else mask.withColumn("_k", F.lit(0).cast("long"))
    open_ = m.select(*keys).distinct().join(m.filter("u = 0 AND v = 0").select(*keys), keys, "left_anti")
    back = complement(m.join(open_, keys, "left_semi"), h, w, keys, open_)
    labels = pixel_components(back, keys, w, 4, frame=F.col(keys[0]), h=h)
    holes = labels.filter(F.col("label") != F.col(keys[0]) * (h * w)).select(*keys, *UV)
    out = m.select(*keys, *UV).union(holes).distinct()
    return out if key else out.select(*UV)


def stencil(image: DataFrame, keys: Sequence[str], value: str, weights: dict[str, dict[tuple[int, int], float]]) -> DataFrame:
    """Weighted sums of the neighbourhood of every pixel of the image, a column for each set of weights; what lies outside counts as 0."""
    cells = sorted({o for w in weights.values() for o in w})
    names = list(weights)
    kernel = [(du, dv, *[weights[n].get((du, dv), 0.0) for n in names]) for du, dv in cells]
    sent = image.select(*keys, *UV, F.col(value).alias("_x"), _offsets(kernel, ("du", "dv", *[f"w{i}" for i in range(len(names))])).alias("o"))
    sent = sent.select(*keys, (F.col("u") - F.col("o.du")).cast("int").alias("u"), (F.col("v") - F.col("o.dv")).cast("int").alias("v"), *[(F.col("_x") * F.col(f"o.w{i}")).alias(f"_w{i}") for i in range(len(names))])
    total = sent.groupBy(*keys, *UV).agg(*[F.sum(f"_w{i}").alias(n) for i, n in enumerate(names)])
    return image.join(total, [*keys, *UV])


#: The 3 by 3 Sobel weights, and the 5-tap Gaussian of sigma 1.
SOBEL = (1.0, 2.0, 1.0)
GAUSS = (0.05448868454964294, 0.24420134200323332, 0.4026199468942474, 0.24420134200323332, 0.05448868454964294)


def gradient(depth: DataFrame, keys: Sequence[str], value: str = "depth") -> DataFrame:
    """Depth with the magnitude `grad` of its Sobel gradient."""
    gx = {(du, dv): du * SOBEL[dv + 1] for du in (-1, 0, 1) for dv in (-1, 0, 1)}
    gy = {(du, dv): dv * SOBEL[du + 1] for du in (-1, 0, 1) for dv in (-1, 0, 1)}
    out = stencil(depth, keys, value, {"_gx": gx, "_gy": gy})
    return out.withColumn("grad", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_gx", "_gy")


def smooth(depth: DataFrame, keys: Sequence[str], value: str = "depth") -> DataFrame:
    """Depth smoothed by the 5 by 5 Gaussian over all pixels, written back only where there is a depth."""
    w = {(du, dv): GAUSS[du + 2] * GAUSS[dv + 2] for du in range(-2, 3) for dv in range(-2, 3)}
    out = stencil(depth, keys, value, {"_s": w})
    return out.withColumn(value, F.when(F.col(value) > 0, F.col("_s")).otherwise(F.col(value))).drop("_s")


#: The 5-tap kernel that smooths 8-bit images.
BINOMIAL = (1, 4, 6, 4, 1)


def height_view(heights: DataFrame, keys: Sequence[str], h: int, w: int, value: str = "height", flat: bool = True) -> DataFrame:
    """(keys, u, v, level): heights of masks as 0 to 255: clipped to their 5th to 99th percentile, spread, truncated, and smoothed over the image.

    The image is 0 off the mask and mirrored at its edges, without its outermost pixels; a smoothed level is rounded half up and pixels of level 0 are left out. A flat mask
    is 255 throughout and not smoothed, unless flat is false: then it is spread and smoothed like any other.
    """
    e = heights.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.99))).alias("_e"))
    q = heights.join(e, list(keys)) if keys else heights.join(F.broadcast(e))
    lo, hi = F.col("_e")[0], F.col("_e")[1]
    level = (F.least(F.greatest(F.col(value), lo), hi) - lo) / (hi - lo + 1e-6) * 255
    q = q.select(*keys, *UV, F.floor(F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0))).cast("int").alias("level"), (F.lit(flat) & (hi <= lo + 1e-6)).alias("_flat"))

    def places(c: str, n: int) -> Column:
        """Where a pixel stands along an axis, mirrored places beyond the edges included."""
        x = F.col(c)
        return F.filter(F.array(x, F.when(x.between(1, 2), -x), F.when(x.between(n - 3, n - 2), 2 * (n - 1) - x)), lambda p: p.isNotNull())

    taps = _offsets([(du, dv, a * b) for du, a in zip(range(-2, 3), BINOMIAL, strict=True) for dv, b in zip(range(-2, 3), BINOMIAL, strict=True)], ("du", "dv", "k"))
    seen = q.filter("NOT _flat").withColumn("_u", F.explode(places("u", w))).withColumn("_v", F.explode(places("v", h)))
    sent = seen.select(*keys, "level", "_u", "_v", taps.alias("o")).select(*keys, (F.col("_u") + F.col("o.du")).cast("int").alias("u"), (F.col("_v") + F.col("o.dv")).cast("int").alias("v"), (F.col("level") * F.col("o.k")).alias("_x"))
    smooth_ = sent.filter(f"u >= 0 AND u < {w} AND v >= 0 AND v < {h}").groupBy(*keys, *UV).agg(F.floor((F.sum("_x") + 128) / 256).cast("int").alias("level")).filter("level > 0")
    return smooth_.unionByName(q.filter("_flat").select(*keys, *UV, F.lit(255).alias("level")))


def check_depth(depth: DataFrame, keys: Sequence[str], h: int, w: int) -> DataFrame:
    """(keys, ok): whether a depth image has every pixel of its frame once and none beside."""
    return depth.groupBy(*keys).agg((F.count("*") == h * w).alias("_a"), (F.countDistinct("u", "v") == h * w).alias("_b"), F.expr(f"min(u) >= 0 AND max(u) < {w} AND min(v) >= 0 AND max(v) < {h}").alias("_c")).select(*keys, F.expr("_a AND _b AND _c").alias("ok"))


def boundary_score(a: DataFrame, b: DataFrame, full: DataFrame, gradient_map: DataFrame, h: int, w: int, size: int = 7) -> DataFrame:
    """One row `score`: the depth gradient where two masks meet against that of the whole mask; 0 with fewer than 20 pixels."""
    line = band(a, b, [], h, w, size).join(full.select(*UV), list(UV), "left_semi").join(gradient_map, list(UV))
    here = line.agg(F.count("*").alias("n"), F.avg("grad").alias("m"), F.percentile("grad", F.lit(0.9)).alias("p"))
    there = full.select(*UV).join(gradient_map, list(UV)).agg(F.avg("grad").alias("all"))
    return here.join(there).select(F.when(F.col("n") < 20, F.lit(0.0)).otherwise((0.5 * F.col("m") + 0.5 * F.col("p")) / (F.coalesce("all", F.lit(0.0)) + 1e-6)).alias("score"))


def distance_transform(mask: DataFrame, h: int, w: int, keys: Sequence[str] = ()) -> DataFrame:
    """Masks with `dist`, the exact Euclidean distance to the nearest background pixel of their image; h + w where there is none.

    Two passes: the nearest background in a pixel's own row, then the least over the pixels of its column, as the squared distance is a sum. What
    a pixel's own row and column have bounds how far along the column it has to look. With keys all frames go through at once, a task for each of their rows and columns.
    """
    at = [*keys, *UV]
    back = complement(mask, h, w, keys).select(*at, F.lit(True).alias("_b"))
    line = mask.select(*at, F.lit(False).alias("_b")).unionByName(back)

    def gap(along: str, across: str) -> Column:
        order = Window.partitionBy(*keys, across).orderBy(along)
        seen = F.when(F.col("_b"), F.col(along))
        before = F.last(seen, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first(seen, True).over(order.rowsBetween(0, Window.unboundedFollowing))
        return F.least(F.col(along) - before, after - F.col(along)).cast("long")

    line = line.withColumn("_g", gap("u", "v")).withColumn("_c", gap("v", "u"))
    reach = F.least(F.col("_g"), F.col("_c"), F.lit(h - 1)).cast("int")
    first, last = F.greatest(-reach, -F.col("v")).cast("int"), F.least(reach, F.lit(h - 1) - F.col("v")).cast("int")
    looks = line.filter("NOT _b").select(*at, F.explode(F.sequence(first, last)).alias("_d"))
    looks = looks.select(*keys, "u", F.col("v").alias("_v"), (F.col("v") + F.col("_d")).cast("int").alias("v"), "_d")
    met = looks.join(line.select(*at, "_g"), at).select(*keys, "u", F.col("_v").alias("v"), (F.col("_g") * F.col("_g") + F.col("_d") * F.col("_d")).alias("_s"))
    least = met.groupBy(*at).agg(F.min("_s").alias("_s"))
    return mask.select(*at).join(least, at).select(*at, F.coalesce(F.sqrt("_s"), F.lit(float(h + w))).alias("dist"))


def voronoi_split(mask: DataFrame, h: int, w: int, peak_ratio: float = 0.45, least_peak: int = 200, least_part: int = 180) -> DataFrame:
    """(u, v, part): one frame's mask cut in two by the nearer of the two largest peaks of its distance transform.

    Ties go to the first. No rows with fewer than two peaks, or if a part is smaller than least_part after a 3 by 3 closing.
    """
    dist = distance_transform(mask, h, w)
    top = dist.agg((F.max("dist") * peak_ratio).alias("_t"))
    peaks = areas(pixel_components(dist.join(top).filter("dist >= _t").select(*UV), [], w), []).filter(F.col("area") >= least_peak)
    two = peaks.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("area"), "label"))).filter("_r <= 2")
    pair = two.agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("_r") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("cu", "cv")]).filter("_n = 2")
    near = mask.select(*UV).join(F.broadcast(pair))
    d = [(F.col("u") - F.col(f"cu{i}")) * (F.col("u") - F.col(f"cu{i}")) + (F.col("v") - F.col(f"cv{i}")) * (F.col("v") - F.col(f"cv{i}")) for i in (1, 2)]
    parts = near.select(F.when(d[0] <= d[1], 1).otherwise(2).alias("part"), *UV)
    parts = close(parts, ["part"], square(3), h, w)
    sizes = parts.groupBy("part").count().agg(F.count("*").alias("_k"), F.min("count").alias("_m")).filter(f"_k = 2 AND _m >= {least_part}")
    return parts.join(F.broadcast(sizes)).select(*UV, "part")


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (inter, union, iou) of two masks; 0 if both are empty."""
    both = a.select(*UV, F.lit(1).alias("_a")).join(b.select(*UV, F.lit(1).alias("_b")), list(UV), "full")
    n = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("inter"), F.count("*").alias("union"))
    return n.withColumn("iou", F.when(F.col("union") == 0, F.lit(0.0)).otherwise(F.col("inter") / F.greatest("union", F.lit(1))))


def bounding_box(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    return mask.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in UV for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("area"))


def resize_nearest(mask: DataFrame, h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """One frame's mask at another size, by nearest pixel."""
    out = grid(mask.sparkSession, to_h, to_w).withColumns({"_u": F.expr(f"CAST(u * {w} DIV {to_w} AS INT)"), "_v": F.expr(f"CAST(v * {h} DIV {to_h} AS INT)")})
    return out.join(mask.select(F.col("u").alias("_u"), F.col("v").alias("_v")), ["_u", "_v"], "left_semi").select(*UV)


def mask_or_zeros(frames: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, area, readable) for all frames: a mask that can't be read has no pixel."""
    n = mask.groupBy(*keys).agg(F.count("*").alias("area"))
    return frames.select(*keys).distinct().join(n, list(keys), "left").select(*keys, F.coalesce("area", F.lit(0).cast("long")).alias("area"), F.col("area").isNotNull().alias("readable"))


def split_points(points: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Points (with their pixel u, v) with `side`: a or b by the mask that holds the pixel, the nearer centroid if both do, ties to a; others go."""
    mids = [m.agg(F.avg("u").alias(f"_{n}u"), F.avg("v").alias(f"_{n}v")) for m, n in ((a, "a"), (b, "b"))]
    q = points.join(a.select(*UV, F.lit(1).alias("_a")), list(UV), "left").join(b.select(*UV, F.lit(1).alias("_b")), list(UV), "left")
    q = q.filter("_a IS NOT NULL OR _b IS NOT NULL").join(F.broadcast(mids[0])).join(F.broadcast(mids[1]))
    d = {n: (F.col("u") - F.col(f"_{n}u")) * (F.col("u") - F.col(f"_{n}u")) + (F.col("v") - F.col(f"_{n}v")) * (F.col("v") - F.col(f"_{n}v")) for n in "ab"}
    side = F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").when(d["a"] <= d["b"], "a").otherwise("b")
    return q.withColumn("side", side).drop("_a", "_b", "_au", "_av", "_bu", "_bv")


def support(pixels: DataFrame, keys: list[str], h: int, w: int, band: float, least: int, inside: float, margin: int, edge_inside: float) -> DataFrame:
    """Per mask: whether its lowest pixels stand on the table.

    pixels: keys, u, v, height (signed, null without depth) and on_table. One row (keys, bottom, inside_ratio, at_edge, reason), reason null if it stands.
    """
    g = pixels.groupBy(*keys).agg(F.count("height").alias("_n"), (F.percentile("height", F.lit(0.05)) + band).alias("_t"), F.min("u").alias("_u0"), F.max("u").alias("_u1"), F.min("v").alias("_v0"), F.max("v").alias("_v1"))
    low = pixels.join(g, keys).groupBy(*keys, "_n", "_u0", "_u1", "_v0", "_v1").agg(F.count_if(F.col("height") <= F.col("_t")).alias("bottom"), F.count_if((F.col("height") <= F.col("_t")) & F.col("on_table")).alias("_in"))
    low = low.withColumns({"inside_ratio": F.col("_in") / (F.col("bottom") + 1e-6), "at_edge": F.expr(f"_u0 < {margin} OR _v0 < {margin} OR _u1 >= {w - margin} OR _v1 >= {h - margin}")})
    reason = F.when(F.col("_n") == 0, "empty_mask_or_invalid_depth").when(F.col("bottom") < least, "too_few_bottom_pixels").when(F.col("inside_ratio") < inside, "bottom_inside_ratio_too_low").when(F.col("at_edge") & (F.col("inside_ratio") < edge_inside), "edge_instance_with_low_support")
    return low.select(*keys, "bottom", "inside_ratio", "at_edge", reason.alias("reason"))
