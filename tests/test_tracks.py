"""The query of tracks does the whole of confirmation on its own rows: shapes wait, are confirmed, and recordings don't meet."""

import numpy as np

from cairn.config import StateConfig
from cairn.plans.catalog import QUERIES
from cairn.sources.fixtures import SIZES, surfaces
from cairn.streaming import tracks

CONFIRM = {"same_shape", "not_sure_enough", "pending_update", "switch_confirmed"}


def _vectors(n=600):
    rng = np.random.default_rng(5)
    return [(i, rng.normal(scale=0.125, size=64).astype(np.float32), int(rng.integers(3))) for i in range(n)]


def _folded(rows):
    """The events of a recording, from its vectors one by one."""
    seen = {}
    for i, v, label in rows:
        for x, y, z in v[:63].astype(float).reshape(-1, 3):
            n = (np.sqrt(x * x + y * y + z * z), max(abs(x), abs(y), abs(z)), max(np.sqrt(x * x + y * y), abs(z)))[label % 3]
            a, b, c = SIZES[label % 3]
            seen.setdefault(i % 20, {}).setdefault(label, []).append((i, x / n * a + label * 0.5, y / n * b, z / n * c))
    state, out = tracks.State(), []
    for k in sorted(seen):
        objects = [{"local_id": label, "points": np.array(sorted(p))[:, 1:], "colour": np.mean([v[3:6].astype(float) for i, v, t in rows if t == label and i % 20 == k], axis=0)} for label, p in seen[k].items()]
        out += tracks.fold_keyframe(state, "", k, objects, StateConfig(min_points=5), True, 0.0)
    return out


def test_tracks_of_the_query_confirm_shapes(spark, tmp_path):
    rows = _vectors()
    table = [(at + i, v.tolist(), label) for at in (0, 2000) for i, v, label in rows]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["track_objects"](spark, str(tmp_path)).collect()
    names = ("keyframe_index", "local_id", "global_id", "event", "obs_count", "points", "shape", "confidence", "pending_count")
    assert {"pending_update", "switch_confirmed"} <= {r.event for r in got}
    assert sum(r.event in CONFIRM for r in got) > 0.7 * len(got)
    assert max(r.pending_count for r in got) == StateConfig().confirmations - 1
    told = {rec: sorted(tuple(str(r[c]) for c in names) for r in got if r.rec_id == rec) for rec in ("0", "2000")}
    assert told["0"] == told["2000"] == sorted(tuple(str(r[c]) for c in names) for r in _folded(rows))
    assert {r.rec_id for r in got} == {"0", "2000"}


def test_points_of_odd_vectors(spark, tmp_path):
    odd = [(0, None, 1), (1, [0.0] * 64, 1), (2, [float("nan")] * 64, 2), (3, [1.0, 2.0], 0), (4, [1.0] * 64, None), (5, [3.0, 0.0, 4.0, None, 1.0, 1.0, float("inf")], 0), (-6, [0.0, -2.0, 1.0], 4)]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.pid, r.x, r.y, r.z) for r in surfaces(spark, str(tmp_path)).collect()}
    assert got == {(5, 0.6 * 0.02, 0.0, 0.8 * 0.02), (-6, 2.0, -0.022, 0.5 * 0.012)}
