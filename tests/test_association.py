"""Greedy matching in rounds against the sequential one, over many keyframes at once."""

import numpy as np

from cairn.operators import association
from cairn.streaming import tracks

SCHEMA = "rec_id string, keyframe_index int, local_id int, x double, y double, z double, r double, g double, b double"


def _scene(pick, recordings=2, keyframes=5, objects=7):
    rows = []
    for rec in range(recordings):
        places = pick.uniform(0, 0.3, (objects, 3))
        for k in range(keyframes):
            for i in pick.permutation(objects)[: objects - (k % 3)]:
                p = places[i] + pick.normal(0, 0.04, 3)
                for q in p + pick.normal(0, 0.01, (9, 3)):
                    rows.append((f"r{rec}", k, int(i), *map(float, q), *map(float, pick.uniform(0, 1, 3))))
    return rows


def test_rounds_equal_the_sequential_greedy(spark):
    rows = _scene(np.random.default_rng(4))
    got = {(r.rec_id, r.keyframe_index, r.local_id): r.global_id for r in association.assign_fixed(spark.createDataFrame(rows, SCHEMA), 0.1).collect()}
    seen = {}
    for rec, k, i, *v in rows:
        seen.setdefault((rec, k), {}).setdefault(i, []).append(v)
    want = {}
    for (rec, k), objects in sorted(seen.items()):
        signs = {i: tracks.signature(np.array(p)[:, :3], np.array(p)[:, 3:].mean(axis=0)) for i, p in sorted(objects.items())}
        if k == 0:
            templates = dict(enumerate(signs.values(), 1))
            ids = list(templates)
        else:
            ids = tracks.assign(start[rec], list(signs.values()), 0.1)
        if k == 0:
            start = (locals().get("start") or {}) | {rec: templates}
        want |= {(rec, k, i): g for i, g in zip(signs, ids, strict=True)}
    assert got == want and -1 in got.values()


def test_one_to_one_and_ties(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.5), (0, 1, 2, 0.5), (0, 2, 1, 0.5), (0, 2, 2, 0.9), (1, 1, 1, 0.2), (1, 2, 1, 0.1)], "f int, local_id int, global_id int, cost double")
    assert {(r.f, r.local_id, r.global_id) for r in association.greedy(pairs, ["f"]).collect()} == {(0, 1, 1), (0, 2, 2), (1, 2, 1)}
    assert association.greedy(pairs.limit(0), ["f"]).isEmpty()


def test_small_objects_and_summary(spark):
    rows = [("a", 0, 1, 0.01 * i, 0.0, 0.0, 0.5, 0.5, 0.5) for i in range(6)] + [("a", 0, 2, 5.0, 0.0, 0.0, 0.1, 0.1, 0.1)] + [("a", 3, 4, 0.01 * i, 0.01, 0.0, 0.5, 0.5, 0.5) for i in range(4)] + [("a", 3, 5, 9.0, 9.0, 9.0, 0.0, 0.0, 0.0)] * 4
    points = spark.createDataFrame(rows, SCHEMA)
    got = association.assign_fixed(points, 0.1, 3)
    assert {(r.keyframe_index, r.local_id): r.global_id for r in got.collect()} == {(0, 1): 1, (0, 2): -1, (3, 4): 1, (3, 5): -1}
    one = association.fused_summary(points, got).collect()
    assert len(one) == 1 and (one[0].num_points, one[0].num_members) == (10, 2) and [tuple(m) for m in one[0].members] == [(0, 1), (3, 4)] and abs(one[0].cx - 0.025) < 1e-9
    assert association.assign_fixed(points.limit(0)).isEmpty()


def test_nearest_at_any_distance(spark):
    pick = np.random.default_rng(6)
    p, t = pick.normal(0, 1, (60, 3)), np.vstack([pick.normal(0, 1, (5, 3)), [[40.0, 0, 0], [40.0, 0, 0]]])
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(np.vstack([p, [[41.0, 0, 0]]]))], "pid long, x double, y double, z double")
    templates = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(t)], "global_id int, x double, y double, z double")
    got = {r.pid: (r.global_id, round(r.dist, 9)) for r in association.nearest(points, templates, 0.05).collect()}
    far = np.linalg.norm(np.vstack([p, [[41.0, 0, 0]]])[:, None] - t[None], axis=2)
    assert got == {i: (int(d.argmin()), round(float(d.min()), 9)) for i, d in enumerate(far)}
    assert got[60] == (5, 1.0)
    assert association.nearest(points, templates.limit(0), 0.5).isEmpty() and association.nearest(points.limit(0), templates, 0.5).isEmpty()
