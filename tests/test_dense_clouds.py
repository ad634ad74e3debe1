"""Kernels and operators on dense clouds: no list of all near pairs, and the results of comparing all pairs."""

import time
import tracemalloc

import numpy as np
import pytest

from cairn.functions import kernels, split
from cairn.operators import cloud


def _cloud(n: int, kind: str, seed: int = 0) -> np.ndarray:
    p = np.random.default_rng(seed).normal(0, 0.125, (n, 3))
    if kind == "copies":
        p[: n // 2] = p[0]
    if kind == "apart":
        p[n // 3 :] += 1.5
    return p


def _all_pairs(p: np.ndarray, k: int, eps: float, least: int):
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    other = np.where(np.eye(len(p), dtype=bool), np.inf, d)
    first = np.sort(other, axis=1)[:, :k]
    core = (d <= eps).sum(axis=1) >= least
    label = np.where(core, np.arange(len(p)), len(p))
    near = (d <= eps) & core[:, None] & core[None]
    while True:
        low = np.where(near, label[None], len(p)).min(axis=1)
        low = np.where(core, np.minimum(low, label), len(p))
        if np.array_equal(low, label):
            break
        label = low
    to = np.where(core[None] & (d <= eps), d, np.inf)
    out = np.where(core, label, np.where(np.isfinite(to.min(axis=1)), label[to.argmin(axis=1)], -1))
    return first[:, -1], first.mean(axis=1), out, core


@pytest.mark.parametrize("kind", ["one", "copies", "apart"])
def test_kernels_equal_all_pairs(kind):
    p = _cloud(400, kind)
    kth, mean, label, core = _all_pairs(p, 8, 0.07, 4)
    got = split.knn(p, 8)
    assert np.allclose(got[0], kth) and np.allclose(got[1], mean)
    assert np.array_equal(split.dbscan(p, 0.07, 4), label)
    assert np.array_equal(split.components(p, 0.07, core)[core], label[core])


@pytest.mark.parametrize("what", ["dbscan", "components", "knn", "refine"])
def test_memory_of_dense_clouds(what):
    """Of 6000 points within reach of each other there are 36 million pairs, which no kernel may hold; for knn the points lie in a lump and a thin halo."""
    p = _cloud(6000, "one") * (0.1 if what != "knn" else 1)
    if what == "knn":
        p[300:] *= 0.01
    tracemalloc.start()
    if what == "refine":
        from cairn.config import SplitConfig

        split.by_neck(p, SplitConfig(min_points=30, min_points_each=5, voxel=0.0, radius=0.2))
    else:
        {"dbscan": lambda: split.dbscan(p, 0.5, 4), "components": lambda: split.components(p, 0.5), "knn": lambda: split.knn(p, 8)}[what]()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6


def _filled(p: np.ndarray, h: int, w: int) -> np.ndarray:
    """Every edge against every pixel."""
    v, u = np.mgrid[0:h, 0:w]
    inside, on = np.zeros((h, w), bool), np.zeros((h, w), bool)
    for a, b in zip(p.astype(float), np.roll(p, -1, axis=0).astype(float), strict=True):
        cross = (b[0] - a[0]) * (v - a[1]) - (b[1] - a[1]) * (u - a[0])
        between = (min(a[0], b[0]) - 1e-9 <= u) & (u <= max(a[0], b[0]) + 1e-9) & (min(a[1], b[1]) - 1e-9 <= v) & (v <= max(a[1], b[1]) + 1e-9)
        on |= (np.abs(cross) < 1e-9) & between
        if a[1] != b[1]:
            inside ^= ((a[1] > v) != (b[1] > v)) & (u < (b[0] - a[0]) * (v - a[1]) / (b[1] - a[1]) + a[0])
    return inside | on


def test_polygons_are_filled_by_the_rows_of_their_edges():
    """A long outline in a large image takes its own pixels, not image times outline."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        h, w = (int(x) for x in rng.integers(3, 30, 2))
        p = rng.integers(-3, 33, (int(rng.integers(1, 9)), 2))
        assert np.array_equal(kernels.filled(p, h, w), _filled(p, h, w))
    side = np.arange(2000)
    ring = np.concatenate([np.stack(x, axis=1) for x in ((side, 0 * side), (0 * side + 2000, side), (2000 - side, 0 * side + 2000), (0 * side, 2000 - side))])
    start = time.process_time()
    assert kernels.filled(ring, 2001, 2001).all()
    assert time.process_time() - start < 20


@pytest.fixture(scope="module")
def clouds(spark):
    """Groups: one lump, half copies, two lumps far apart, few points, one point, copies only."""
    groups = [_cloud(150, "one"), _cloud(120, "copies", 1), _cloud(120, "apart", 2), _cloud(5, "one", 3), _cloud(1, "one"), np.zeros((20, 3))]
    rows = [(g, g * 1000 + i, *map(float, x)) for g, p in enumerate(groups) for i, x in enumerate(p)]
    return groups, spark.createDataFrame(rows, "g int, pid long, x double, y double, z double")


def test_nearest_of_groups(clouds, monkeypatch):
    groups, df = clouds
    monkeypatch.setattr(cloud, "_met", None)  # no list of all pairs within the given radius
    got = {r.pid: (r.kth, r.mean) for r in cloud.nearest(df, ["g"], 8, 0.3).collect()}
    for g, p in enumerate(groups):
        for i, want in enumerate(zip(*split.knn(p, 8), strict=True)):
            assert np.allclose(got[g * 1000 + i], want), (g, i)


def test_dbscan_of_groups(clouds, monkeypatch):
    groups, df = clouds
    monkeypatch.setattr(cloud, "near_pairs", None)
    got = {r.pid: r.label for r in cloud.dbscan(df, 0.07, 4, ["g"]).collect()}
    parts = {r.pid: r.label for r in cloud.radius_components(df, 0.07, ["g"]).collect()}
    for g, p in enumerate(groups):
        for i, (a, b) in enumerate(zip(split.dbscan(p, 0.07, 4), split.components(p, 0.07), strict=True)):
            assert got[g * 1000 + i] == (None if a < 0 else g * 1000 + a)
            assert parts[g * 1000 + i] == g * 1000 + b


def test_nearest_without_keys(clouds):
    groups, df = clouds
    got = {r.pid: r.kth for r in cloud.nearest(df.filter("g = 1").drop("g"), [], 8, 0.3).collect()}
    assert np.allclose([got[1000 + i] for i in range(len(groups[1]))], split.knn(groups[1], 8)[0])
