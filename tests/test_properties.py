"""Properties that hold for any input: kernels by generated examples, DataFrame operators on a few seeds."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from cairn.functions import kernels, shapes, split, stats
from cairn.functions.exprs import inverse_rigid, rigid
from cairn.operators import cloud, raster

IMAGES = hnp.arrays(bool, st.tuples(st.integers(1, 12), st.integers(1, 12)))
CLOUDS = hnp.arrays(float, st.tuples(st.integers(1, 40), st.just(3)), elements=st.floats(-2, 2, width=32))
KERNELS = [raster.square(3), raster.ellipse(3), raster.ellipse(5)]


@settings(max_examples=60, deadline=None)
@given(IMAGES, st.sampled_from(KERNELS))
def test_closing_and_opening(image, kernel):
    grown, shrunk = kernels.shift_any(image, kernel), ~kernels.shift_any(~image, kernel)
    assert (image <= grown).all() and (shrunk <= image).all()
    once, opened = kernels.closed(image, kernel), kernels.opened(image, kernel)
    assert (image <= once).all() and (opened <= image).all()
    assert (kernels.closed(once, kernel) == once).all() and (kernels.opened(opened, kernel) == opened).all()


@settings(max_examples=60, deadline=None)
@given(IMAGES)
def test_parts_partition_the_mask(image):
    labels, n = kernels.labelled(image)
    assert ((labels > 0) == image).all() and set(np.unique(labels[labels > 0])) == set(range(1, n + 1))
    assert split.largest_ratio(image) == pytest.approx(max((np.mean(labels[image] == k) for k in range(1, n + 1)), default=0.0))
    assert kernels.labelled(image, 4)[1] >= n


@settings(max_examples=40, deadline=None)
@given(IMAGES)
def test_outline_encloses_its_part(image):
    labels, n = kernels.labelled(image)
    for k in range(1, n + 1):
        part = labels == k
        inside = kernels.filled(kernels.outline(part), *part.shape)
        assert (part <= inside).all()


@settings(max_examples=40, deadline=None)
@given(CLOUDS, st.floats(0.05, 1.0))
def test_voxels_keep_the_mean_and_clusters_partition(p, edge):
    thin = split.voxel_mean(p, edge)
    assert len(thin) <= len(p)
    assert thin.min() >= p.min() - 1e-9 and thin.max() <= p.max() + 1e-9
    label = split.components(p, edge)
    assert all(label[label[i]] == label[i] <= i for i in range(len(p)))


@settings(max_examples=30, deadline=None)
@given(CLOUDS, st.floats(0, 6), st.floats(0, 6))
def test_scales_do_not_turn_with_the_cloud(p, a, b):
    x = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    z = np.array([[math.cos(b), -math.sin(b), 0], [math.sin(b), math.cos(b), 0], [0, 0, 1]])
    assert split.scales(p @ x @ z) == pytest.approx(split.scales(p), abs=1e-5)
    if len(p) > 3 and np.linalg.matrix_rank(p - p.mean(axis=0)) == 3:
        q, axes, c, _ = shapes.pca_frame(p)
        assert np.linalg.det(axes) == pytest.approx(1) and q @ axes.T + c == pytest.approx(p, abs=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.floats(0, 1)), min_size=2, max_size=3, unique_by=lambda x: x[0]), st.sampled_from("abcd"))
def test_choice_is_the_best_or_the_previous_one(candidates, previous):
    got = shapes.choose([{"shape": s, "score": x} for s, x in candidates], previous)
    scores = sorted((x for _, x in candidates), reverse=True)
    assert got["score"] == scores[0] or (got["shape"] == previous and scores[0] - scores[1] < 0.06)


def frame(spark, seed, n=60):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return spark.createDataFrame([(int(i % 2), i, *map(float, x)) for i, x in enumerate(p)], "obj int, pid long, x double, y double, z double"), p


@pytest.mark.parametrize("seed", [1, 2])
def test_rigid_motion_keeps_distances_and_inverts(spark, seed):
    d, p = frame(spark, seed)
    t = [0.36, 0.48, -0.8, 1.0, -0.8, 0.6, 0.0, -2.0, 0.48, 0.64, 0.6, 0.5, 0.0, 0.0, 0.0, 1.0]
    moved = rigid(d, t).withColumn("t", F.array(*[F.lit(v) for v in t]))
    q = np.array([[r.x, r.y, r.z] for r in moved.orderBy("pid").collect()])
    assert np.linalg.norm(q[1:] - q[:-1], axis=1) == pytest.approx(np.linalg.norm(p[1:] - p[:-1], axis=1))
    back = rigid(moved.withColumn("i", inverse_rigid("t")), "i").orderBy("pid").collect()
    assert np.array([[r.x, r.y, r.z] for r in back]) == pytest.approx(p)


@pytest.mark.parametrize("seed", [3, 4])
def test_eigenvalues_equal_numpy(spark, seed):
    d, p = frame(spark, seed)
    for r in stats.with_eigenvalues(stats.covariance(d, ["obj"])).collect():
        want = np.linalg.eigvalsh(np.cov(p[r.obj :: 2].T))
        assert [r.l3, r.l2, r.l1] == pytest.approx(want.tolist())


@pytest.mark.parametrize("seed", [5])
def test_voxel_counts_and_components_on_spark(spark, seed):
    d, p = frame(spark, seed)
    v = cloud.voxel_mean(d, ["obj"], 0.5).collect()
    assert sum(r.n for r in v) == len(p)
    got = {r.pid: r.label for r in cloud.radius_components(d.withColumn("obj", F.lit(0)), 0.6).collect()}
    want = split.components(p, 0.6)
    assert [got[i] for i in range(len(p))] == want.tolist()
    dense = {r.pid: r.label for r in cloud.dbscan(d, 0.6, 4).collect()}
    mine = split.dbscan(p, 0.6, 4)
    assert [dense[i] if dense[i] is not None else -1 for i in range(len(p))] == mine.tolist()
