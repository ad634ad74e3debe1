"""Column builders: camera and plane arithmetic, scores and enumerations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(c)))


def dot(a: Sequence[str | Column], b: Sequence[float | Column]) -> Column:
    """Sum of products, left to right."""
    terms = [_c(x) * y for x, y in zip(a, b, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def normalized(v: Sequence[str | Column]) -> list[Column]:
    """v divided by its length, with a floor that keeps the zero vector."""
    length = F.sqrt(dot(v, [_c(x) for x in v])) + F.lit(1e-12)
    return [_c(x) / length for x in v]


def plane_distance(n: Sequence[float], d: float, at: Sequence[str] = XYZ) -> Column:
    """Signed distance of the points to the plane n . p + d = 0."""
    return dot(at, [F.lit(float(x)) for x in n]) + F.lit(float(d))


def depth_metres(raw: str | Column, unit: str = "u16", scale: float = 0.001) -> Column:
    """Depth in metres: raw integers times the scale, or metres as they are; null stays null."""
    return _c(raw).cast("double") * F.lit(scale) if unit == "u16" else _c(raw).cast("double")


def valid_depth(z: str | Column, low: float = 1e-6, high: float = 10.0) -> Column:
    """Depth with invalid values (too small, too large, not finite) as 0."""
    z = _c(z)
    return F.when(z.isNull() | F.isnan(z) | (z < low) | (z > high), F.lit(0.0)).otherwise(z)


def back_project(pixels: DataFrame, k: Sequence[float], scale: float, keep_invalid: bool = False, depth: str = "depth_u16") -> DataFrame:
    """Pixels with x, y, z in the camera frame; k is (fx, fy, cx, cy). Without a depth the pixel is dropped unless keep_invalid."""
    fx, fy, cx, cy = (F.lit(float(v)) for v in k)
    out = pixels.withColumn("z", F.coalesce(_c(depth).cast("double") * F.lit(scale), F.lit(0.0)))
    out = out.withColumns({"x": (F.col("u") - cx) * F.col("z") / fx, "y": (F.col("v") - cy) * F.col("z") / fy})
    return out if keep_invalid else out.filter(F.col("z") > 1e-6)


def colours(bgr: Sequence[str] = ("b", "g", "r")) -> dict[str, Column]:
    """r, g, b in 0 to 1 from 8-bit channels."""
    return {name: F.col(c) / F.lit(255.0) for name, c in zip(("b", "g", "r"), bgr, strict=True)}


def project_trunc(points: DataFrame, k: Sequence[float], h: int, w: int) -> DataFrame:
    """Points in front of the camera with their pixel u, v, truncated towards zero; those outside the image are dropped."""
    fx, fy, cx, cy = (F.lit(float(v)) for v in k)
    seen = points.filter(F.col("z") > 1e-6)
    seen = seen.withColumns({"u": (fx * F.col("x") / F.col("z") + cx).cast("int"), "v": (fy * F.col("y") / F.col("z") + cy).cast("int")})
    return seen.filter(f"u >= 0 AND u < {w} AND v >= 0 AND v < {h}")


def project_round(points: DataFrame, k: Sequence[float], h: int, w: int) -> DataFrame:
    """All points with their pixel u, v, rounded half to even, and `inside`."""
    fx, fy, cx, cy = (F.lit(float(v)) for v in k)
    z = F.greatest(F.col("z"), F.lit(1e-6))
    out = points.withColumns({"u": F.rint(fx * F.col("x") / z + cx).cast("long"), "v": F.rint(fy * F.col("y") / z + cy).cast("long")})
    return out.withColumn("inside", F.expr(f"z > 1e-6 AND u >= 0 AND u < {w} AND v >= 0 AND v < {h}"))


def rigid(points: DataFrame, t: Sequence[float] | str) -> DataFrame:
    """Points moved by a 4x4 row-major transform, given as 16 numbers or as the name of an array column."""
    cell = [F.col(t)[i] for i in range(16)] if isinstance(t, str) else [F.lit(float(v)) for v in t]
    return points.withColumns({a: dot(XYZ, cell[4 * i : 4 * i + 3]) + cell[4 * i + 3] for i, a in enumerate(XYZ)})


def inverse_rigid(t: str) -> Column:
    """The inverse of a rigid transform in an array column: transposed rotation, and the translation turned back; null stays null."""
    c = [F.col(t)[i] for i in range(16)]
    rows = []
    for i in range(3):
        turned = [c[i], c[4 + i], c[8 + i]]
        rows += [*turned, -(turned[0] * c[3] + turned[1] * c[7] + turned[2] * c[11])]
    return F.when(F.col(t).isNotNull(), F.array(*rows, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))


def confidence(score: str | Column) -> Column:
    """high above 0.80, medium above 0.60, else low."""
    return F.when(_c(score) > 0.80, "high").when(_c(score) > 0.60, "medium").otherwise("low")


def confidence_rank(name: str | Column) -> Column:
    return F.when(_c(name) == "high", 2).when(_c(name) == "medium", 1).otherwise(0)


#: What a prior shape adds to a candidate's score.
PRIOR_BIAS = {
    ("sphere", "sphere"): 0.10, ("sphere", "box"): -0.08, ("sphere", "cylinder"): 0.02,
    ("cylinder", "cylinder"): 0.10, ("cylinder", "sphere"): -0.04, ("cylinder", "box"): -0.06,
    ("box", "box"): 0.10, ("box", "sphere"): -0.08, ("box", "cylinder"): -0.02,
}


def with_prior(score: str | Column, shape: str | Column, prior: str | Column) -> Column:
    """The score with its prior bias, clipped to 0 to 1."""
    bias = F.lit(0.0)
    for (p, s), v in PRIOR_BIAS.items():
        bias = F.when((_c(prior) == p) & (_c(shape) == s), F.lit(v)).otherwise(bias)
    return clip(_c(score) + bias, 0.0, 1.0)


def projection_axis(name: str | Column) -> Column:
    """The PCA axis that a projection looks along; an unknown name is an error."""
    bad = F.raise_error(F.concat(F.lit("unknown projection: "), F.coalesce(_c(name), F.lit("null"))))
    return F.when(_c(name) == "p12", "z").when(_c(name) == "p13", "y").when(_c(name) == "p23", "x").otherwise(bad.cast("string"))


def axis_vector(name: str | Column) -> Column:
    unit = lambda *v: F.array(*[F.lit(x) for x in v])
    bad = F.raise_error(F.concat(F.lit("unknown axis: "), F.coalesce(_c(name), F.lit("null"))))
    return F.when(_c(name) == "x", unit(1.0, 0.0, 0.0)).when(_c(name) == "y", unit(0.0, 1.0, 0.0)).when(_c(name) == "z", unit(0.0, 0.0, 1.0)).otherwise(bad.cast("array<double>"))


def from_pca(v: Sequence[str], rotation: str, center: str | None = None) -> list[Column]:
    """A vector of the PCA frame in the world: R . v, plus the centre if one is given; rotation is a row-major array column."""
    out = [dot(v, [F.col(rotation)[3 * i + j] for j in range(3)]) for i in range(3)]
    return [o + F.col(center)[i] for i, o in enumerate(out)] if center else out


def finite(at: Sequence[str] = XYZ) -> Column:
    """Whether all coordinates are finite numbers."""
    out = F.lit(True)
    for c in at:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out


def to_json(row: DataFrame) -> DataFrame:
    """Every row as one JSON object in the column `json`."""
    return row.select(F.to_json(F.struct("*")).alias("json"))
