"""Tracks as keyed state: a stream over restarts equals the table, and both follow the ordered fold of a whole recording."""

import json
import time
from dataclasses import replace

import numpy as np
import pytest

from cairn.config import StateConfig
from cairn.sources import frames
from cairn.streaming import keyed, tracks

from .test_kernels import sphere

CFG = StateConfig(min_points=20, geometry_min_points=100, geometry_min_accumulated=150, least_confidence="low", confirmations=2)


def _observed(keyframes=6):
    """Two recordings; a ball of which a cap is seen first, a box, and something too small."""
    pick, rows, ball = np.random.default_rng(8), [], sphere()
    ball -= ball.mean(axis=0)
    cap = ball[ball[:, 2] > np.quantile(ball[:, 2], 0.8)]
    for rec in ("a", "b"):
        for k in range(keyframes):
            seen = cap if k < 1 else ball
            for i, p in enumerate((pick.choice(seen, 300), pick.uniform(-1, 1, (60, 3)) * (0.08, 0.03, 0.02) + (0.5, 0, 0), pick.uniform(0, 0.01, (5, 3)) + (0, 1, 0))):
                if rec == "b" and i == 1 and k == 3:
                    continue
                rows.append((rec, k, i, *(p[:, j].tolist() for j in range(3)), 0.1 * i, 0.5, 0.5))
    return rows


RANK = {"infer": 1, "pending_update": 2, "switch_confirmed": 3}


def _rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, keyed.ROCKSDB)
    yield
    spark.conf.set(name, before)


def _streamed(spark, at, batches, **options):
    """HISTORY after a run for each batch of rows, every run from the same checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, tracks.OBSERVATION).coalesce(1).write.mode("append").parquet(f"file://{at}/in")
        stream = keyed.history_stream(frames.frame_stream(spark, f"file://{at}/in", 100, tracks.OBSERVATION), CFG, **options)
        query = stream.writeStream.format("parquet").option("path", f"file://{at}/out").option("checkpointLocation", f"file://{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"file://{at}/out")


@pytest.mark.parametrize("fixed", [True, False])
def test_stream_over_restarts_equals_the_table(spark, rocksdb, tmp_path, fixed):
    rows = _observed()
    batch = keyed.history_batch(spark.createDataFrame(rows, tracks.OBSERVATION), CFG, fixed)
    late = [r for r in rows if r[1] == 1][:1]
    out = _streamed(spark, tmp_path, [[r for r in rows if r[1] < 2], [r for r in rows if r[1] in (2, 3)], [r for r in rows if r[1] > 3] + late], fixed=fixed)
    assert _rows(out.filter("event <> 'late'")) == _rows(batch)
    assert [(r.rec_id, r.keyframe_index, r.global_id) for r in out.filter("event = 'late'").collect()] == [(late[0][0], 1, -1)]


def test_history_follows_the_fold(spark):
    observed, cfg = spark.createDataFrame(_observed(), tracks.OBSERVATION), replace(CFG, confirmations=1)
    history = keyed.history_batch(observed, cfg).collect()
    fold = tracks.track_batch(observed, cfg).collect()
    last = {}
    for r in sorted(history, key=lambda r: (r.keyframe_index, r.event == "switch_confirmed")):
        last[r.rec_id, r.keyframe_index, r.local_id] = r
    for r in fold:
        mine = last[r.rec_id, r.keyframe_index, r.local_id]
        assert (mine.global_id, mine.obs_count, mine.points) == (r.global_id, r.obs_count, r.points)
    events = {}
    for r in history:
        events.setdefault((r.rec_id, r.keyframe_index, r.local_id), []).append(r.event)
    told = {"init": ["init"], "updated": ["updated"], "same_shape": ["infer", "updated"], "not_sure_enough": ["infer", "updated"], "pending_update": ["infer", "pending_update", "updated"], "switch_confirmed": ["infer", "pending_update", "switch_confirmed", "updated"]}
    for r in fold:
        assert sorted(events[r.rec_id, r.keyframe_index, r.local_id]) == told.get(r.event, [r.event]), r
    assert {"infer", "pending_update", "switch_confirmed", "too_few_raw_points"} <= {r.event for r in history}
    ends = {(r.rec_id, r.global_id): r.shape for r in sorted(fold, key=lambda r: r.keyframe_index) if r.global_id > 0}
    mine = {(r.rec_id, r.global_id): r for r in sorted(history, key=lambda r: (r.keyframe_index, RANK.get(r.event, 0))) if r.global_id > 0}
    assert {k: r.shape for k, r in mine.items()} == ends
    assert all(json.loads(r.params) for r in history if r.shape)


def test_allowed_identities_and_voxels(spark):
    observed = spark.createDataFrame(_observed(3), tracks.OBSERVATION)
    some = keyed.history_batch(observed, CFG, allowed=frozenset({1})).collect()
    assert {r.event for r in some if r.global_id == 2} == {"not_in_allowed_global_ids"} and {r.event for r in some if r.global_id == 1} >= {"init", "updated"}
    thin = keyed.history_batch(observed, CFG, voxel=0.02).collect()
    assert max(r.points for r in thin) < max(r.points for r in keyed.history_batch(observed, CFG).collect())


def test_silent_recordings_are_forgotten(spark, rocksdb, tmp_path):
    """Timers need a query that keeps running: one that takes what is there and ends would wait for them without an end."""
    rows, at = _observed(1), f"file://{tmp_path}"

    def land():
        spark.createDataFrame(rows, tracks.OBSERVATION).coalesce(1).write.mode("append").parquet(f"{at}/in")

    def begun():
        return spark.read.schema(stream.schema).parquet(f"{at}/out").filter("event = 'init'").count() if (tmp_path / "out").exists() else 0

    def wait(enough):
        for _ in range(120):
            if enough():
                return True
            time.sleep(0.5)
        return False

    land()
    stream = keyed.history_stream(frames.frame_stream(spark, f"{at}/in", 100, tracks.OBSERVATION), CFG, idle_ms=1)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(processingTime="1 second").start()
    try:
        assert wait(lambda: begun() == 4)
        passed = query.lastProgress.batchId
        assert wait(lambda: query.lastProgress.batchId > passed + 1)
        land()
        assert wait(lambda: begun() == 8)
    finally:
        query.stop()
