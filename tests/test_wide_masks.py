"""Distances and splits on masks wider than the catalogue's images."""

import numpy as np

from cairn.functions import kernels
from cairn.operators import raster


def rows_of(spark, mask):
    v, u = np.nonzero(mask)
    return spark.createDataFrame([*zip(u.tolist(), v.tolist(), strict=True)], "u int, v int")


def two_discs():
    v, u = np.mgrid[:180, :380]
    near = lambda cu: (u - cu) ** 2 + (v - 90) ** 2 <= 80**2
    return near(95) | near(285) | ((abs(v - 90) <= 30) & (u >= 95) & (u <= 285))


def test_distances_have_no_cap(spark):
    mask = two_discs()
    want = kernels.distance(mask)
    got = raster.distance_transform(rows_of(spark, mask), *mask.shape).collect()
    assert len(got) == mask.sum() and max(r.dist for r in got) > 64
    assert all(abs(r.dist - want[r.v, r.u]) < 1e-9 for r in got)
    assert {r.dist for r in raster.distance_transform(rows_of(spark, np.ones((5, 9), bool)), 5, 9).collect()} == {14.0}


def test_wide_neck_is_split(spark):
    mask = two_discs()
    parts = {r.part: r["count"] for r in raster.voronoi_split(rows_of(spark, mask), *mask.shape).groupBy("part").count().collect()}
    assert sorted(parts) == [1, 2] and min(parts.values()) > 0.4 * mask.sum()
