"""Kernels against definitions, and shape inference on synthetic surfaces."""

import numpy as np
import pytest

from cairn.config import SplitConfig
from cairn.functions import kernels, shapes, split

RNG = np.random.default_rng(4)


def sphere(r=0.05, n=3000):
    v = RNG.normal(size=(n, 3))
    return r * v / np.linalg.norm(v, axis=1, keepdims=True) + RNG.normal(scale=0.0005, size=(n, 3)) + (0.1, 0.2, 0.8)


def cylinder(r=0.03, h=0.16, n=4000):
    a, z = RNG.uniform(0, 2 * np.pi, n), RNG.uniform(-h / 2, h / 2, n)
    return np.stack([r * np.cos(a), r * np.sin(a), z], axis=1) + RNG.normal(scale=0.0005, size=(n, 3))


def box(size=(0.12, 0.08, 0.05), n=6000):
    p = RNG.uniform(-0.5, 0.5, (n, 3))
    side = RNG.integers(0, 3, n)
    p[np.arange(n), side] = np.where(RNG.random(n) < 0.5, -0.5, 0.5)
    return p * size + RNG.normal(scale=0.0005, size=(n, 3))


def thin(p):
    return split.voxel_mean(p, 0.004)


def test_outline_of_a_rectangle():
    m = np.zeros((20, 30), bool)
    m[4:12, 5:21] = True
    path = kernels.outline(m)
    assert kernels.polygon_area(path) == 7 * 15 and kernels.polygon_length(path) == 2 * (7 + 15)
    f = kernels.contour_features(m)
    assert f["valid"] and f["corners"] == 4 and f["aspect_ratio"] == 2.0
    assert f["rectangularity"] == pytest.approx(105 / 128)


def test_outline_of_odd_masks():
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert len(kernels.outline(one)) == 1 and not kernels.contour_features(one)["valid"]
    assert not kernels.contour_features(np.zeros((4, 4), bool))["valid"]
    for _ in range(20):
        m = RNG.random((12, 12)) < 0.6
        labels, n = kernels.labelled(m)
        for k in range(1, n + 1):
            path = kernels.outline(labels == k)
            assert all(labels[v, u] == k for u, v in path)
            step = np.abs(path - np.roll(path, -1, axis=0)).max(axis=1)
            assert len(path) == 1 or step.max() == 1


def test_disc_is_rounder_than_a_bar():
    v, u = np.mgrid[0:60, 0:60]
    disc = kernels.contour_features((u - 30) ** 2 + (v - 30) ** 2 <= 25**2)
    bar = kernels.contour_features((abs(u - 30) <= 25) & (abs(v - 30) <= 3))
    assert disc["circularity"] > 0.82 > 0.5 > bar["circularity"] and bar["line_support"] > 0.5


def test_least_rectangle_of_a_turned_one():
    a = 0.4
    turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    p = RNG.uniform(-0.5, 0.5, (4000, 2)) * (8, 3) @ turn.T
    corners, w, h, _ = kernels.least_rectangle(p)
    assert sorted((w, h)) == pytest.approx([3, 8], rel=0.03)
    assert kernels.rectangle_fit(p * 0.02)["score"] > 0.9


def test_distance_is_exact():
    m = RNG.random((15, 18)) < 0.8
    d = kernels.distance(m)
    bv, bu = np.nonzero(~m)
    for v, u in zip(*np.nonzero(m), strict=True):
        assert d[v, u] == pytest.approx(np.sqrt(((bv - v) ** 2 + (bu - u) ** 2).min()))


@pytest.mark.parametrize("make,shape", [(sphere, "sphere"), (cylinder, "cylinder"), (box, "box")])
def test_shapes_are_told_apart(make, shape):
    before = {"shape": "box", "confidence": "low", "allow_upgrade": True, "allow_downgrade": False, "params": {}}
    got = shapes.infer(thin(make()), before)
    assert got["shape"] == shape
    if shape == "sphere":
        assert got["params"]["diameter"] == pytest.approx(0.10, rel=0.05)
        assert got["params"]["center"] == pytest.approx([0.1, 0.2, 0.8], abs=0.005)
    if shape == "cylinder":
        assert got["params"]["radius"] == pytest.approx(0.03, rel=0.1) and abs(got["params"]["axis"][2]) > 0.99
        assert not got["allow_upgrade"] and shapes.infer(thin(sphere()), got) is got


def test_too_few_points_keep_the_previous_geometry():
    before = {"shape": "sphere", "confidence": "high", "allow_upgrade": True, "allow_downgrade": True, "params": {}}
    assert shapes.infer(thin(box())[:50], before) is before


def test_first_geometry():
    v, u = np.mgrid[0:40, 0:40]
    disc = (u - 20) ** 2 + (v - 20) ** 2 <= 15**2
    assert shapes.initial(sphere(), disc)["shape"] == "sphere"
    assert shapes.initial(cylinder(), None)["shape"] == "cylinder"
    assert shapes.initial(box(), None)["shape"] == "box"
    assert shapes.initial(box()[:10], None)["shape"] == "box" and shapes.initial(np.zeros((0, 3)), None)["params"]["sx"] == 0.01


def test_choice_prefers_the_previous_shape_in_a_near_tie_at_any_rank():
    c = [{"shape": "a", "score": 0.80}, {"shape": "b", "score": 0.78}, {"shape": "c", "score": 0.10}]
    assert shapes.choose(c, "c")["shape"] == "c" and shapes.choose(c, "z")["shape"] == "a"
    c[1]["score"] = 0.70
    assert shapes.choose(c, "c")["shape"] == "a"


@pytest.mark.parametrize("shape,params,v,f", [("box", {"sx": 1, "sy": 2, "sz": 3}, 8, 12), ("sphere", {"diameter": 2}, 642, 1280), ("cylinder", {"radius": 1, "height": 2}, 66, 128)])
def test_meshes_are_closed_and_face_outwards(shape, params, v, f):
    vertices, faces = shapes.mesh({"shape": shape, "params": params}, 1.1)
    assert (len(vertices), len(faces)) == (v, f)
    edges = [tuple(e) for t in faces for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)
    a, b, c = (vertices[faces[:, i]] for i in range(3))
    volume = float((np.cross(a, b) * c).sum() / 6)
    want = {"box": 6, "sphere": 4 / 3 * np.pi, "cylinder": 2 * np.pi}[shape] * 1.1**3
    assert volume == pytest.approx(want, rel=0.02)
    with pytest.raises(ValueError):
        shapes.mesh({"shape": "cone", "params": {}}, 1.0)
    assert shapes.mesh_or_initial({"shape": "box", "params": {}}, {"shape": shape, "params": params})[0].shape[0] == v
    assert shapes.mesh_or_initial({"shape": "box", "params": {}}, None) is None


def test_neighbours_components_and_clusters_equal_brute_force():
    p = RNG.uniform(0, 1, (300, 3))
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    kth, mean = split.knn(p, 5)
    s = np.sort(d, axis=1)[:, 1:6]
    assert np.allclose(kth, s[:, -1]) and np.allclose(mean, s.mean(axis=1))
    label = split.components(p, 0.12)
    for i, j in zip(*np.nonzero(d <= 0.12), strict=True):
        assert label[i] == label[j]
    assert len(split.clusters(p, 0.12, 1)) == len(set(label.tolist()))


def test_two_touching_blobs_are_split_and_one_is_not():
    camera = split.Camera((500.0, 500.0, 160.0, 120.0), 240, 320)

    def ball(x):
        v = RNG.normal(size=(6000, 3))
        return 0.04 * v / np.linalg.norm(v, axis=1, keepdims=True) + (x, 0, 0.6)

    cfg = SplitConfig(voxel=0.003, min_gap=0.002, radius=0.0055, density_factor=0.5)
    two = np.vstack([ball(-0.043), ball(0.043)])
    got = split.refine(two, camera.mask(two), camera, cfg, None)
    assert len(got) == 2 and {m for _, m in got} == {"split"}
    one = ball(0.0)
    got = split.refine(one, camera.mask(one), camera, cfg, None)
    assert len(got) == 1


def test_gates_name_what_failed():
    camera = split.Camera((500.0, 500.0, 160.0, 120.0), 240, 320)
    p = RNG.normal(scale=0.01, size=(2000, 3)) + (0, 0, 0.6)
    why = lambda full, parts: split.evaluate(full, parts, camera, SplitConfig(), None, None)[2]
    assert why(p, [p]) == "less_than_two_clusters" and why(p[:100], [p, p]) == "too_few_total_points"
    assert why(p, [p[:1000], p[:50]]) == "cluster_too_small" and why(p, [p[:1000], p[1000:]]) == "center_dist_too_small"
    # The second cluster is held against all points of the object, those that a split leaves out included.
    whole = np.vstack([p, p + (0.2, 0, 0)])
    assert why(whole, [p[:900], p[:400] + (0.2, 0, 0)]) == "second_cluster_ratio_too_small"
    assert why(whole, [p[:900], p[:700] + (0.2, 0, 0)]) != "second_cluster_ratio_too_small"


def test_grid_neighbours_equal_all_pairs():
    p = np.vstack([RNG.uniform(size=(300, 3)), RNG.normal(scale=0.01, size=(100, 3)), [[5.0, 5.0, 5.0]]])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    got = {(int(a), int(b)) for x, y, _ in split.near_pairs(p, 0.1, 50) for a, b in zip(x, y, strict=True)}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero((d <= 0.1) & ~np.eye(len(p), dtype=bool)), strict=True)}
    near = np.sort(d, axis=1)[:, 1:8]
    kth, mean = split.knn(p, 7)
    assert np.allclose(kth, near[:, -1]) and np.allclose(mean, near.mean(axis=1))
    assert split.knn(p[:1], 3)[0].tolist() == [1e6] and np.allclose(split.knn(np.zeros((5, 3)), 3)[0], 0)


def test_colours_go_through_cleaning():
    p = np.hstack([RNG.normal(scale=0.01, size=(500, 3)), np.tile([0.2, 0.4, 0.6], (500, 1))])
    q = split.denoise(p, 0.003, 10, 1.5, "large")
    assert q.shape[1] == 6 and np.allclose(q[:, 3:], [0.2, 0.4, 0.6])
