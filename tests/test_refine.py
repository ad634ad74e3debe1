"""Refinement of one chosen object."""

import numpy as np
import pytest

from cairn.config import SplitConfig
from cairn.functions import split
from cairn.operators import objects

CAMERA = split.Camera((300.0, 300.0, 80.0, 60.0), 120, 160)
CFG = SplitConfig(min_points=200, min_points_each=40, min_mask_area=20, voxel=0.0, min_density=1.0)


@pytest.mark.parametrize("with_depth", [False, True])
def test_one_object_by_keys_of_any_text(spark, with_depth):
    pick, rows, masks = np.random.default_rng(1), [], []
    for name, x in (("it's", 0.0), ('a "b"', 0.08)):
        p = np.vstack([pick.normal(0, 0.006, (300, 3)) + (x - 0.03, 0, 0.5), pick.normal(0, 0.006, (300, 3)) + (x + 0.03, 0, 0.5)])
        rows += [(1, name, i, *map(float, q)) for i, q in enumerate(p)]
        masks += [(1, name, int(u), int(v)) for v, u in zip(*np.nonzero(CAMERA.mask(p)), strict=True)]
    points, mask = spark.createDataFrame(rows, "f int, name string, pid long, x double, y double, z double"), spark.createDataFrame(masks, "f int, name string, u int, v int")
    depth = spark.createDataFrame([(1, u, v, 0.5 if u < 80 else 0.9) for u in range(160) for v in range(120)], "f int, u int, v int, depth double") if with_depth else None
    keys = ["f", "name"]
    every = objects.refine(points, mask, depth, keys, ["f"], CAMERA, CFG, edges=False)
    for name in ("it's", 'a "b"'):
        one = objects.debug_refine(points, mask, depth, keys, ["f"], CAMERA, {"f": 1, "name": name}, CFG).collect()
        assert {r.name for r in one} == {name} and sorted(map(tuple, one)) == sorted(tuple(r) for r in every.collect() if r.name == name)
    assert objects.debug_refine(points, mask, depth, keys, ["f"], CAMERA, {"name": "none"}, CFG).isEmpty()
