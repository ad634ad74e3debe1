"""Outlines and lines over all masks at once, against the kernels that follow one outline, and against counts by hand."""

import math

import numpy as np
import pytest

from cairn.functions import kernels
from cairn.operators import objects, outline

SCHEMA = "k string, u int, v int"


def _masks(spark, images, at=(0, 0)):
    rows = [(k, int(u) + at[0], int(v) + at[1]) for k, image in images.items() for v, u in zip(*np.nonzero(image), strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def images():
    pick = np.random.default_rng(5)
    out = {f"noise{i}": pick.random((14, 17)) < d for i, d in enumerate((0.15, 0.35, 0.5, 0.65, 0.8))}
    v, u = np.mgrid[0:30, 0:30]
    out["disc"] = (u - 14) ** 2 + (v - 14) ** 2 <= 100
    out["ring"] = out["disc"] & ((u - 14) ** 2 + (v - 14) ** 2 >= 30)
    out["islet"] = out["ring"] | ((abs(u - 14) <= 1) & (abs(v - 14) <= 1))
    out["line"] = (v == 3) & (u < 25)
    out["slant"] = (u == v) & (u < 20)
    out["dot"] = (u == 2) & (v == 2)
    out["bar"] = (abs(u - 14) <= 12) & (abs(v - 14) <= 2)
    return out


def _hole_filled(image):
    back, _ = kernels.labelled(np.pad(~image, 1, constant_values=True), 4)
    return ~(back == back[0, 0])[1:-1, 1:-1]


def test_outlines_equal_followed_ones(spark, images):
    found = {r.k: r for r in outline.outlines(_masks(spark, images, (-7, 40)), ["k"]).collect()}
    assert set(found) == set(images)
    for k, image in images.items():
        labels, n = kernels.labelled(_hole_filled(image))
        paths = [kernels.outline(labels == i) for i in range(1, n + 1)]
        path, r = max(paths, key=kernels.polygon_area), found[k]
        assert (r.area, r.w, r.h) == (kernels.polygon_area(path), *(np.ptp(path, axis=0) + 1)), k
        assert math.isclose(r.length, kernels.polygon_length(path), abs_tol=1e-9), k
        assert r.valid == (r.area > 1)
        if r.valid:
            assert math.isclose(r.circularity, 4 * math.pi * r.area / r.length**2) and math.isclose(r.rectangularity, r.area / (r.w * r.h))


def test_filled(spark, images):
    got = {}
    for r in outline.filled(_masks(spark, images), ["k"]).collect():
        got.setdefault(r.k, set()).add((r.u, r.v))
    assert got == {k: {(int(u), int(v)) for v, u in zip(*np.nonzero(_hole_filled(i)), strict=True)} for k, i in images.items()}


def test_lines(spark):
    v, u = np.mgrid[0:40, 0:40]
    images = {"two": (v == 5) & (u < 30) | (u == 35) & (v > 8), "dashed": (v == 4) & (u % 4 == 0), "gappy": (v == 4) & (u % 5 == 0), "slant": u == v, "cut": (v == 9) & ((u < 12) | (u > 14) & (u < 30)), "far": (v == 9) & ((u < 12) | (u > 15) & (u < 30))}
    mask = _masks(spark, images)
    shortest = mask.select("k").distinct().selectExpr("k", "8 AS least")
    runs = {}
    for r in outline.line_runs(mask, ["k"], shortest, votes=8).collect():
        runs.setdefault(r.k, []).append((r.u0, r.v0, r.u1, r.v1))
    assert sorted(runs["two"]) == [(0, 5, 29, 5), (35, 9, 35, 39)]
    assert runs["dashed"] == [(0, 4, 36, 4)] and "gappy" not in runs
    assert runs["slant"] == [(0, 0, 39, 39)]
    assert runs["cut"] == [(0, 9, 29, 9)] and sorted(runs["far"]) == [(0, 9, 11, 9), (16, 9, 29, 9)]
    few = outline.line_votes(mask.filter("k = 'slant'"), ["k"], 40).collect()
    assert [(r.angle, r.rho, r.votes) for r in few] == [(135, 0, 40)]


def test_features_of_shapes(spark, images):
    got = {r.k: r for r in outline.features(_masks(spark, {k: images[k] for k in ("disc", "bar", "dot")}), ["k"]).collect()}
    assert got["disc"].circularity > 0.82 > 0.5 > got["bar"].circularity
    assert got["bar"].line_support == 1.0 and got["bar"].rectangularity > 0.7
    assert not got["dot"].valid and got["dot"].line_support == 0.0


def test_no_mask(spark):
    none = _masks(spark, {})
    assert outline.outlines(none, ["k"]).isEmpty() and outline.features(none, ["k"]).isEmpty()


def test_projection_features(spark):
    pick = np.random.default_rng(2)
    p = pick.uniform(0, [0.3, 0.06, 0.02], (3000, 3))
    rows = [(1, i, *map(float, x)) for i, x in enumerate(p)] + [(2, i, 0.0, float(i), 0.0) for i in range(4)] + [(1, 10**6, float("nan"), 0.0, 0.0)]
    got = {(r.obj, r.view): r for r in objects.projection_features(spark.createDataFrame(rows, "obj int, pid long, x double, y double, z double"), ["obj"]).collect()}
    assert len(got) == 6 and got[2, "xy"].pca_ratio == 999.0 and not got[2, "xy"].valid
    seen = got[1, "xy"]
    low, high = np.linalg.eigvalsh(np.cov(p[:, :2].T))
    assert seen.valid and seen.line_support == 1.0 and seen.rectangularity > 0.8 and math.isclose(seen.pca_ratio, high / low, rel_tol=1e-6)
