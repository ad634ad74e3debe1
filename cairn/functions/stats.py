"""Grouped statistics of points: robust extents, covariance eigenvalues and least squares, as aggregate columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import XYZ, clip


def spread(c: str, low: float, high: float) -> Column:
    """The difference of two quantiles of a column, interpolated linearly."""
    q = F.percentile(c, F.array(F.lit(low), F.lit(high)))
    return q[1] - q[0]


def summary(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: n, the median centre, the extent between the 5th and 95th percentile and its length, the density, a robust box."""
    out = points.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.percentile(c, F.lit(0.5)).alias(f"c{c}") for c in XYZ],
        *[spread(c, 0.05, 0.95).alias(f"e{c}") for c in XYZ],
        *[F.greatest(spread(c, 0.02, 0.98), F.lit(0.01)).alias(f"s{c}") for c in XYZ],
    )
    volume = F.greatest("ex", F.lit(1e-4)) * F.greatest("ey", F.lit(1e-4)) * F.greatest("ez", F.lit(1e-4))
    out = out.withColumn("scale", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")))
    return out.withColumn("density", F.when(F.col("n") < 10, F.lit(0.0)).otherwise(F.col("n") / volume))


def mean_colour(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("r", "g", "b")])


def covariance(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: n, means and the six sample covariances."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.covar_samp(a, b).alias(f"{a}{b}") for a, b in pairs])


def with_eigenvalues(c: DataFrame) -> DataFrame:
    """Covariances with their eigenvalues l1 >= l2 >= l3, in closed form."""
    out = c.withColumn("_q", (F.col("xx") + F.col("yy") + F.col("zz")) / 3)
    out = out.withColumn("_p1", F.col("xy") * F.col("xy") + F.col("xz") * F.col("xz") + F.col("yz") * F.col("yz"))
    off = [F.col(f"{a}{a}") - F.col("_q") for a in XYZ]
    out = out.withColumn("_p", F.sqrt((off[0] * off[0] + off[1] * off[1] + off[2] * off[2] + 2 * F.col("_p1")) / 6))
    a, b, d = (x / F.greatest(F.col("_p"), F.lit(1e-300)) for x in off)
    e, f, g = (F.col(x) / F.greatest(F.col("_p"), F.lit(1e-300)) for x in ("xy", "xz", "yz"))
    out = out.withColumn("_r", (a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)) / 2)
    out = out.withColumn("_phi", F.acos(clip("_r", -1.0, 1.0)) / 3)
    out = out.withColumns({"l1": F.col("_q") + 2 * F.col("_p") * F.cos("_phi"), "l3": F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_phi") + 2 * math.pi / 3)})
    return out.withColumn("l2", 3 * F.col("_q") - F.col("l1") - F.col("l3")).drop("_q", "_p1", "_p", "_r", "_phi")


def pca_scales(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: n and the roots of the covariance eigenvalues, largest first, with a floor of 1e-12 under the roots; 0 for fewer than 10 points."""
    c = with_eigenvalues(covariance(points, keys))
    return c.select(*keys, "n", *[F.when(F.col("n") < 10, F.lit(0.0)).otherwise(F.sqrt(F.greatest(f"l{i}", F.lit(1e-12)))).alias(f"s{i}") for i in (1, 2, 3)])


def shape_flags(scales: DataFrame) -> DataFrame:
    """Scales with `bad_shape` (a thread or a sheet) and `thin_rod` (no candidate for a split)."""
    ratio12 = F.col("s1") / F.greatest("s2", F.lit(1e-6))
    ratio23 = F.col("s2") / F.greatest("s3", F.lit(1e-6))
    return scales.withColumns({"bad_shape": (F.col("n") < 20) | ((ratio12 > 8) & (ratio23 > 6)), "thin_rod": (ratio12 > 10) & (ratio23 < 2.5)})


def fit_circle(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per group: the least-squares circle cx, cy, radius, the root mean square of its residuals and the score; invalid under 8 points.

    The normal equations are set up about the mean, which keeps them well conditioned, and solved by Cramer's rule.
    """
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    q = points.join(m, list(keys)).withColumns({"_a": F.col(x) - F.col("_mx"), "_b": F.col(y) - F.col("_my")})
    q = q.withColumn("_s", F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))
    t = q.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.avg("_s").alias("_ms"),
        *[F.sum(F.col(i) * F.col(j)).alias(n) for n, i, j in (("aa", "_a", "_a"), ("ab", "_a", "_b"), ("bb", "_b", "_b"), ("as_", "_a", "_s"), ("bs", "_b", "_s"))],
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    ok = (F.col("n") >= 8) & (F.abs(det) > 1e-18)
    safe = F.when(ok, det)
    t = t.withColumns({"_ca": (F.col("as_") * F.col("bb") - F.col("bs") * F.col("ab")) / (2 * safe), "_cb": (F.col("bs") * F.col("aa") - F.col("as_") * F.col("ab")) / (2 * safe)})
    t = t.withColumns({"cx": F.col("_mx") + F.col("_ca"), "cy": F.col("_my") + F.col("_cb"), "radius": F.sqrt(F.col("_ca") * F.col("_ca") + F.col("_cb") * F.col("_cb") + F.col("_ms"))})
    r = points.join(t.select(*keys, "n", "cx", "cy", "radius"), list(keys))
    d = F.sqrt((F.col(x) - F.col("cx")) * (F.col(x) - F.col("cx")) + (F.col(y) - F.col("cy")) * (F.col(y) - F.col("cy"))) - F.col("radius")
    r = r.groupBy(*keys, "n", "cx", "cy", "radius").agg(F.sqrt(F.avg(d * d)).alias("rmse"))
    r = r.withColumn("nrmse", F.col("rmse") / F.greatest("radius", F.lit(1e-6)))
    return r.withColumns({"valid": F.col("radius").isNotNull(), "score": F.coalesce(clip(1 - F.col("nrmse") / 0.18, 0.0, 1.0), F.lit(0.0))})


def fit_sphere(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: the least-squares sphere cx, cy, cz, radius and the standard deviation of its residuals; null under 4 points."""
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_m{c}") for c in XYZ])
    q = points.join(m, list(keys)).withColumns({f"_{c}": F.col(c) - F.col(f"_m{c}") for c in XYZ})
    q = q.withColumn("_s", F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    t = q.groupBy(*keys).agg(
        F.first("n").alias("n"), *[F.first(f"_m{c}").alias(f"_m{c}") for c in XYZ], F.avg("_s").alias("_ms"),
        *[F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"{a}{b}") for a, b in pairs], *[F.sum(F.col(f"_{a}") * F.col("_s")).alias(f"{a}s") for a in "xyz"],
    )
    c = {k: F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz", "xs", "ys", "zs")}

    def det(a, b, d, e, f, g, h, i, j) -> Column:
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    full = det(c["xx"], c["xy"], c["xz"], c["xy"], c["yy"], c["yz"], c["xz"], c["yz"], c["zz"])
    safe = 2 * F.when((F.col("n") >= 4) & (F.abs(full) > 1e-30), full)
    t = t.withColumns(
        {
            "_cx": det(c["xs"], c["xy"], c["xz"], c["ys"], c["yy"], c["yz"], c["zs"], c["yz"], c["zz"]) / safe,
            "_cy": det(c["xx"], c["xs"], c["xz"], c["xy"], c["ys"], c["yz"], c["xz"], c["zs"], c["zz"]) / safe,
            "_cz": det(c["xx"], c["xy"], c["xs"], c["xy"], c["yy"], c["ys"], c["xz"], c["yz"], c["zs"]) / safe,
        }
    )
    r2 = F.col("_cx") * F.col("_cx") + F.col("_cy") * F.col("_cy") + F.col("_cz") * F.col("_cz") + F.col("_ms")
    t = t.withColumns({f"c{a}": F.col(f"_m{a}") + F.col(f"_c{a}") for a in XYZ} | {"radius": F.when(r2 > 1e-10, F.sqrt(r2))})
    r = points.join(t.select(*keys, "n", "cx", "cy", "cz", "radius"), list(keys))
    d = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in XYZ), F.lit(0.0))) - F.col("radius")
    return r.groupBy(*keys, "n", "cx", "cy", "cz", "radius").agg(F.stddev_pop(d).alias("residual_std"), F.sqrt(F.avg(d * d)).alias("residual_rmse"))


def radius_profile(points: DataFrame, keys: Sequence[str], axis: Sequence[float], slices: int = 9, least: int = 20) -> DataFrame:
    """Per group: how the median distance to an axis through the mean varies over equal slices along it.

    The slices lie between the 5th and 95th percentile of the position along the axis, the last one closed at both ends. Valid
    with 50 points and 4 slices of `least` points or more.
    """
    length = math.sqrt(sum(a * a for a in axis)) + 1e-12
    unit = [a / length for a in axis]
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_m{c}") for c in XYZ])
    q = points.join(m, list(keys)).withColumns({f"_v{c}": F.col(c) - F.col(f"_m{c}") for c in XYZ})
    q = q.withColumn("_t", sum((F.col(f"_v{c}") * F.lit(a) for c, a in zip(XYZ, unit, strict=True)), F.lit(0.0)))
    rest = [F.col(f"_v{c}") - F.col("_t") * F.lit(a) for c, a in zip(XYZ, unit, strict=True)]
    q = q.withColumn("_r", F.sqrt(sum((x * x for x in rest), F.lit(0.0))))
    ends = q.groupBy(*keys).agg(F.percentile("_t", F.array(F.lit(0.05), F.lit(0.95))).alias("_e"))
    q = q.join(ends, list(keys)).withColumns({"_lo": F.col("_e")[0], "_hi": F.col("_e")[1]})
    q = q.filter("_t >= _lo AND _t <= _hi AND _hi - _lo >= 1e-8")
    q = q.withColumn("_b", F.least(F.floor((F.col("_t") - F.col("_lo")) * slices / (F.col("_hi") - F.col("_lo"))), F.lit(slices - 1)))
    b = q.groupBy(*keys, "n", "_b").agg(F.count("*").alias("_k"), F.percentile("_r", F.lit(0.5)).alias("_m")).filter(F.col("_k") >= least)
    out = b.groupBy(*keys, "n").agg(F.count("*").alias("slices"), F.avg("_m").alias("mean_radius"), F.stddev_pop("_m").alias("_sd"), (F.max("_m") - F.min("_m")).alias("_range"))
    out = out.filter("n >= 50 AND slices >= 4")
    mean = F.greatest("mean_radius", F.lit(1e-8))
    return out.select(*keys, "n", "slices", "mean_radius", (F.col("_sd") / mean).alias("radius_cv"), (F.col("_range") / mean).alias("radius_range_ratio"))


def robust_trim(points: DataFrame, keys: Sequence[str], keep: float = 0.97) -> DataFrame:
    """Points without those beyond the given quantile of the distance to the group's median; groups that are small (30, or 20 left) stay whole."""
    m = points.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.percentile(c, F.lit(0.5)).alias(f"_m{c}") for c in XYZ])
    q = points.join(m, list(keys)).withColumn("_d", F.sqrt(sum(((F.col(c) - F.col(f"_m{c}")) * (F.col(c) - F.col(f"_m{c}")) for c in XYZ), F.lit(0.0))))
    t = q.groupBy(*keys).agg(F.percentile("_d", F.lit(keep)).alias("_t"))
    q = q.join(t, list(keys))
    left = q.groupBy(*keys).agg(F.count_if(F.col("_d") <= F.col("_t")).alias("_left"))
    q = q.join(left, list(keys)).filter("_n < 30 OR _left < 20 OR _d <= _t")
    return q.drop("_n", "_mx", "_my", "_mz", "_d", "_t", "_left")


def pca_ratios(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: how unequal the variances along its principal axes are: first to third, first to second, second to third; a floor of 1e-6 under the lower ones."""
    c = with_eigenvalues(covariance(points, keys))
    e2, e3 = F.greatest("l2", F.lit(1e-6)), F.greatest("l3", F.lit(1e-6))
    return c.select(*keys, "n", (F.col("l1") / e3).alias("iso"), (F.col("l1") / e2).alias("axis"), (F.col("l2") / e3).alias("mid"))


def face_support(points: DataFrame, keys: Sequence[str], share: float = 0.06) -> DataFrame:
    """Per group: the root mean square distance to the faces of its box from the 2nd to the 98th percentile, relative to its diagonal, and the share of points near
    the faces, the mean of the two best axes."""
    q = {c: F.percentile(c, F.array(F.lit(0.02), F.lit(0.98))) for c in XYZ}
    b = points.groupBy(*keys).agg(*[((q[c][0] + q[c][1]) / 2).alias(f"_m{c}") for c in XYZ], *[F.greatest(q[c][1] - q[c][0], F.lit(1e-6)).alias(f"_s{c}") for c in XYZ])
    p = points.join(b, list(keys)).withColumns({f"_f{c}": F.abs(F.abs(F.col(c) - F.col(f"_m{c}")) - F.col(f"_s{c}") / 2) for c in XYZ})
    near = share * (F.col("_sx") + F.col("_sy") + F.col("_sz")) / 3
    least = F.least("_fx", "_fy", "_fz")
    size = F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy") + F.col("_sz") * F.col("_sz"))
    g = p.groupBy(*keys).agg(F.sqrt(F.avg(least * least)).alias("_r"), F.first(size).alias("_d"), F.array_sort(F.array(*[F.avg((F.col(f"_f{c}") < near).cast("int")) for c in XYZ])).alias("_a"))
    return g.select(*keys, (F.col("_r") / F.greatest("_d", F.lit(1e-6))).alias("nrmse"), ((F.col("_a")[1] + F.col("_a")[2]) / 2).alias("support"))
