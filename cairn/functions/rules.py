"""Scores and decisions, each stated once for numbers and for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Numbers:
    """Operations on Python numbers; None is missing."""

    least, greatest = min, max

    @staticmethod
    def clip(x):
        return float(min(1.0, max(0.0, x)))

    @staticmethod
    def missing(x):
        return x is None

    @staticmethod
    def first(*cases):
        """The value of the first (condition, value) that holds, the last case otherwise; functions are called when they are needed."""
        value = next((v for c, v in cases[:-1] if (c() if callable(c) else c)), cases[-1])
        return value() if callable(value) else value


class Columns:
    """The same on columns; null is missing."""

    @staticmethod
    def _c(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    @classmethod
    def least(cls, *x):
        return F.least(*map(cls._c, x))

    @classmethod
    def greatest(cls, *x):
        return F.greatest(*map(cls._c, x))

    @classmethod
    def clip(cls, x):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cls._c(x)))

    @classmethod
    def missing(cls, x):
        return cls._c(x).isNull()

    @classmethod
    def first(cls, *cases):
        value = lambda v: cls._c(v if isinstance(v, Column) or not callable(v) else v())
        out = None
        for c, v in cases[:-1]:
            c = value(c)
            out = F.when(c, value(v)) if out is None else out.when(c, value(v))
        return out.otherwise(value(cases[-1]))


# The weights and scales of the scores below.


def sphere_score(o, nrmse, iso, axis, circles, circle, rectangle):
    """How much a sphere fits: residual, equal variances, circular views (their number and mean score), less what the rectangles say."""
    parts = 0.45 * o.clip(1 - nrmse / 0.08) + 0.18 * o.clip(1 - (iso - 1) / 2.5) + 0.12 * o.clip(1 - (axis - 1) / 1.5) + 0.17 * o.clip(circles / 2.0) + 0.12 * circle
    return o.clip(parts - 0.08 * o.greatest(rectangle - 0.65, 0.0))


def cylinder_score(o, nrmse, axis, cv, spread, height, radius, circles, rectangles, rectangle, circle, steady=0.12, even=0.22):
    """How much a cylinder fits: residual, elongation, steady radius along the axis, height, the pattern of views, less an unsteady radius."""
    parts = 0.24 * o.clip(1 - nrmse / 0.08) + 0.16 * o.clip((axis - 1) / 2.5) + 0.20 * o.clip(1 - cv / (2 * steady)) + 0.12 * o.clip(1 - spread / (2 * even))
    parts = parts + 0.10 * o.clip((height / o.greatest(2 * radius, 1e-6) - 0.5) / 1.7) + 0.12 * o.clip(0.5 * o.least(circles, 1.0) + 0.5 * o.least(rectangles / 2.0, 1.0)) + 0.03 * rectangle + 0.03 * circle
    return o.clip(parts - 0.10 * o.clip((cv - steady) / 0.20) - 0.10 * o.clip((spread - even) / 0.30))


def box_score(o, nrmse, support, rectangles, circles, rectangle, circle):
    """How much a box fits: residual, points near its faces, rectangular views, less circular ones."""
    parts = 0.42 * o.clip(1 - nrmse / 0.08) + 0.28 * o.clip(support / 0.8) + 0.20 * o.clip(rectangles / 2.0) + 0.06 * rectangle
    return o.clip(parts - 0.18 * o.clip(circles / 2.0) - 0.08 * o.greatest(circle - 0.65, 0.0))


def prior(o, circles, rectangles, cv, spread, steady=0.12, even=0.22):
    """(shape, confidence) that views speak for: circles and rectangles among three, and the radius along the axis of a single circle, if known."""
    some = o.first((o.missing(cv), False), lambda: (cv < steady) & (spread < even))
    shape = o.first((circles > 1, "sphere"), (circles < 1, "box"), (o.missing(cv), "cylinder"), (some, "cylinder"), "sphere")
    sure = o.first((circles > 2, "high"), (circles > 1, "medium"), ((circles < 1) & (rectangles > 1), "medium"), (circles < 1, "low"), (o.missing(cv), "low"), (some, "high"), "medium")
    return shape, sure


def first_shape(o, n, sx, sy, sz, round_mask, discs, disc_xy, planks, least=50):
    """The shape of a cautious first geometry: extents, a round mask, the number of disc-like projections, whether xy is one, whether xz and yz are planks."""
    ratio = lambda a, b: o.greatest(a, b) / o.greatest(o.least(a, b), 1e-6)
    sphere = (ratio(sx, sy) < 1.30) & (ratio(sx, sz) < 1.80) & (ratio(sy, sz) < 1.80) & (round_mask | (discs >= 2))
    cylinder = (ratio(sx, sy) < 1.30) & (sz / o.greatest((sx + sy) / 2, 1e-6) > 1.20) & (disc_xy | planks)
    return o.first((n < least, "box"), (sphere, "sphere"), (cylinder, "cylinder"), "box")


def quality(o, n, bad, density, connected, deep, min_density, min_connected, min_deep):
    """How much a cluster looks like one object; large negative values name what it fails. deep: its connectivity in depth, if known."""
    score = 0.01 * n + 0.0001 * density + 2 * connected
    return o.first((n < 50, -1e6), (bad, -1000.0), (density < min_density, -500.0), (connected < min_connected, -300.0), (o.missing(deep), score), (lambda: deep < min_deep, -250.0), lambda: score + 1.5 * deep)


def can_split(o, n, extent, s1, s2, s3, least, size):
    """Whether an object of n points may be several: large enough, and no thin rod."""
    rod = (s1 / o.greatest(s2, 1e-6) > 10) & (s2 / o.greatest(s3, 1e-6) < 2.5)
    return o.first((n < least, False), (extent < size, False), (rod, False), True)
