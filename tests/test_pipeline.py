"""The keyframe pipeline on a synthetic scene, tracks as batch and as stream, sources and sinks."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.config import MaskConfig, StateConfig, TableConfig
from cairn.functions import shapes
from cairn.functions.kernels import closed, opened, shift_any
from cairn.operators import cloud, raster
from cairn.plans import keyframes
from cairn.sources import frames as sources
from cairn.sources import sinks
from cairn.streaming import tracks

H, W, K = 60, 80, (90.0, 90.0, 40.0, 30.0)


def scene(objects, fid=1):
    """Depth of a table at 1 m, seen from above, with boxes (u0, u1, v0, v1, height) on it."""
    depth = np.full((H, W), 1000)
    for u0, u1, v0, v1, height in objects:
        depth[v0:v1, u0:u1] = 1000 - height
    v, u = np.mgrid[0:H, 0:W]
    depth[(u < 3) | (v < 3) | (u >= W - 3) | (v >= H - 3)] = 0
    return pd.DataFrame({"fid": fid, "u": u.ravel(), "v": v.ravel(), "depth_u16": depth.ravel(), "r": 100, "g": 120, "b": 140})


TABLE = TableConfig(voxel=0.0, remove_outliers=False, iterations=40, min_inlier_ratio=0.2, thickness=0.008)
MASK = MaskConfig(band=0.008, clearance=0.008, close=3, dilate=3, object_dilate=3, table_min_area=500, table_erode=1, min_component_area=20, eps=0.03, min_samples=10, min_cluster_points=40, min_object_area=40, merged_points=100000, merged_area=100000, bottom_band=0.03, min_bottom_pixels=5, min_inside_ratio=0.0, edge_min_inside_ratio=0.0, edge_margin=1, min_final_points=20)


@pytest.fixture(scope="module")
def segmented(spark):
    pdf = pd.concat([scene([(10, 22, 10, 20, 60), (50, 64, 30, 45, 90)]), scene([(12, 24, 11, 21, 60), (51, 65, 30, 45, 90)], 2), scene([], 3)])
    pixels = spark.createDataFrame(pdf).selectExpr("CAST(fid AS BIGINT) AS fid", *[f"CAST({c} AS INT) AS {c}" for c in ("u", "v", "depth_u16", "r", "g", "b")])
    return pixels, keyframes.segment(pixels, K, H, W, 0.001, TABLE, MASK)


def test_segmentation_finds_the_objects(segmented):
    _, seg = segmented
    status = {r.fid: (r.plane_status, r.stage_status) for r in seg.status.collect()}
    assert status[1] == status[2] == ("ok", "ok")
    assert status[3][0] == "ok" and status[3][1] != "ok"
    n = {(r.fid, r.local_id): r for r in seg.points.groupBy("fid", "local_id").agg(F.avg("z").alias("z"), F.avg("u").alias("u")).collect()}
    assert set(n) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert n[1, 1].z == pytest.approx(0.91, abs=0.01) and n[1, 2].z == pytest.approx(0.94, abs=0.01)


def test_tracks_and_fusion(spark, segmented):
    _, seg = segmented
    eye = [float(i == j) for i in range(4) for j in range(4)]
    f = spark.createDataFrame([(1, "r", 1, eye), (2, "r", 2, eye)], "fid long, rec_id string, keyframe_index int, t_wc array<double>")
    points = keyframes.to_reference(seg.points, f)
    events = tracks.track_batch(tracks.observations_of(points), StateConfig(min_points=20))
    got = {(r.keyframe_index, r.local_id): (r.global_id, r.event) for r in events.collect()}
    assert got[1, 1] == (1, "init") and got[1, 2] == (2, "init")
    assert got[2, 1][0] == 1 and got[2, 2][0] == 2
    fused = keyframes.fuse(points, events)
    assert {r.global_id for r in fused.select("global_id").distinct().collect()} == {1, 2}


def test_refine_keeps_single_objects(segmented):
    pixels, seg = segmented
    got = keyframes.refine(seg, pixels, K, H, W)
    assert {r["mode"] for r in got.select("mode").distinct().collect()} == {"fallback_no_secondary_split"}


def observations(n=4):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        for i, c in enumerate(((0, 0, 0), (0.4, 0, 0))):
            p = rng.normal(scale=0.02, size=(80, 3)) + c
            rows.append(("a" if i else "b", k, i, *[p[:, j].tolist() for j in range(3)], 0.5, 0.5, 0.5))
    return rows


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(observations(), tracks.OBSERVATION)
    cfg = StateConfig(min_points=20)
    batch = tracks.track_batch(rows, cfg)
    for k in range(4):
        rows.filter(f"keyframe_index = {k}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = tracks.track_stream(sources.frame_stream(spark, f"file://{tmp_path}/in/*", 1, tracks.OBSERVATION), cfg)
    q = stream.writeStream.foreachBatch(sinks.foreach_keyframe(f"file://{tmp_path}/out")).option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out/events").drop("batch")
    key = lambda r: (r.rec_id, r.keyframe_index, r.local_id)
    got = sorted(got.collect(), key=key)
    # The files of one keyframe may come in any order; a late one changes nothing, so only those in order must agree.
    want = {key(r): r for r in batch.collect()}
    assert len(got) == len(want)
    assert all(tuple(r[c] for c in want[key(r)].__fields__) == tuple(want[key(r)]) for r in got if r.event != "late") or any(r.event == "late" for r in got)


def test_confirmation_passes_over_unsure_candidates():
    def g(shape, sure="high"):
        return {"shape": shape, "confidence": sure}

    t = tracks.Track(np.zeros((1, 3)), np.zeros(3), geometry=g("A"), first=g("A"))
    said = [tracks.confirm(t, g(*c), 3) for c in (("A",), ("B",), ("B", "low"), ("B",), ("B",), ("A",))]
    assert said == ["same_shape", "pending_update", "not_sure_enough", "pending_update", "switch_confirmed", "pending_update"]
    assert t.geometry["shape"] == "B" and t.pending_count == 1


def test_greedy_tracks_and_late_rows():
    state, cfg = tracks.State(), StateConfig(min_points=5)
    row = lambda x, i=1: {"local_id": i, "points": np.random.default_rng(i).normal(scale=0.01, size=(60, 3)) + (x, 0, 0), "colour": np.zeros(3)}
    assert [e["global_id"] for e in tracks.fold_keyframe(state, "r", 1, [row(0), row(0.5, 2)], cfg, False, 0.0)] == [1, 2]
    assert [e["global_id"] for e in tracks.fold_keyframe(state, "r", 2, [row(0.02), row(0.9, 2)], cfg, False, 0.0)] == [1, 3]
    assert tracks.fold_keyframe(state, "r", 2, [row(0)], cfg, False, 0.0)[0]["event"] == "late"
    assert tracks.fold_keyframe(state, "r", 3, [row(0) | {"points": np.zeros((2, 3))}], cfg, False, 0.0)[0]["event"] == "too_few_raw_points"


def test_fixed_identities_are_matched_one_to_one():
    t = {1: np.zeros(9), 2: np.r_[0.05, np.zeros(8)]}
    assert tracks.assign(t, [np.r_[0.04, np.zeros(8)], np.r_[0.045, np.zeros(8)]], 0.1) == [1, 2]
    assert tracks.assign(t, [np.r_[0.9, np.zeros(8)]], 0.1) == [-1]


def test_morphology_equals_arrays(spark):
    rng = np.random.default_rng(3)
    images = {k: rng.random((20, 25)) < 0.55 for k in (0, 1)}
    rows = [(k, int(u), int(v)) for k, m in images.items() for v, u in zip(*np.nonzero(m), strict=True)]
    mask = spark.createDataFrame(rows, "fid long, u int, v int")
    kernel = raster.ellipse(3)

    def image(df, k):
        out = np.zeros((20, 25), bool)
        for r in df.filter(f"fid = {k}").collect():
            out[r.v, r.u] = True
        return out

    for k, m in images.items():
        inner = np.pad(m, 3, constant_values=False)
        assert (image(raster.dilate(mask, ["fid"], kernel, 20, 25), k) == shift_any(m, kernel)).all()
        eroded = image(raster.erode(mask, ["fid"], kernel, 20, 25), k)
        assert (eroded == ~shift_any(~m, kernel)).all() and not (eroded & ~m).any()
        assert (image(raster.close(mask, ["fid"], kernel, 20, 25), k) == closed(m, kernel)).all()
        assert (image(raster.open_(mask, ["fid"], kernel, 20, 25), k) == opened(m, kernel)).all()
        assert inner.any()


def test_hole_fill_leaves_a_mask_with_the_corner_alone(spark):
    ring = [(1, u, v) for u in range(3, 8) for v in range(3, 8) if u in (3, 7) or v in (3, 7)]
    corner = [(2, u, v) for _, u, v in ring] + [(2, 0, 0)]
    got = raster.fill_holes(spark.createDataFrame(ring + corner, "fid long, u int, v int"), 10, 12, "fid")
    n = {r.fid: r["count"] for r in got.groupBy("fid").count().collect()}
    assert n == {1: 25, 2: len(corner)}


def test_plane_fit_statuses(spark):
    rng = np.random.default_rng(1)
    flat = np.c_[rng.uniform(-1, 1, (400, 2)), rng.normal(scale=0.001, size=400)]
    rows = [(1, i, *map(float, p)) for i, p in enumerate(flat)] + [(2, i, *map(float, p)) for i, p in enumerate(rng.uniform(-1, 1, (400, 3)))] + [(3, 0, 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "fid long, pid long, x double, y double, z double")
    got = {r.fid: r for r in cloud.fit_planes(d, "fid", 0.01, 60).collect()}
    assert got[1].status == "ok" and abs(got[1].nz) > 0.99
    assert got[2].status == "inlier_ratio_too_small" and got[3].status == "too_few_points"
    one = cloud.fit_plane(d.filter("fid = 1"), 0.01, 60, up=(0.0, 0.0, -1.0)).first()
    assert one.status == "ok" and one.nz < -0.99
    assert cloud.fit_plane(d.filter("fid = 1"), 0.01, 60, up=(1.0, 0.0, 0.0)).first().status == "plane_rejected_by_normal"
    assert cloud.fit_plane(d.filter("fid = 3")).first().status == "too_few_points"


def test_grid_join_equals_all_pairs_and_knn_is_exact(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 1, (150, 3))
    d = spark.createDataFrame([(i % 2, i, *map(float, x)) for i, x in enumerate(p)], "obj int, pid long, x double, y double, z double")
    got = {(r.a, r.b) for r in cloud.near_pairs(d, ["obj"], 0.2).collect()}
    dist = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if i % 2 == j % 2 and dist[i, j] <= 0.2}
    for radius in (0.05, 0.5):
        for r in cloud.nearest(d, ["obj"], 4, radius).collect():
            s = np.sort(dist[r.pid, [j for j in range(150) if j % 2 == r.obj and j != r.pid]])[:4]
            assert r.kth == pytest.approx(s[-1]) and r["mean"] == pytest.approx(s.mean())


def test_ply_round_trip(spark, tmp_path):
    rows = [(1, i, i * 0.5, -1.0, 2.0, 1.0, 0.0, 0.5) for i in range(5)] + [(2, 0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "obj int, pid long, x double, y double, z double, r double, g double, b double")
    text = {r.obj: r.value for r in sinks.ply_text(d, ["obj"]).collect()}
    for k, v in text.items():
        (tmp_path / f"{k}.ply").write_text(v)
    got = sources.read_ply(spark, f"file://{tmp_path}").orderBy("path", "pid").collect()
    assert [(r.x, r.y, r.z) for r in got] == [r[2:5] for r in rows] and got[0].r == 1.0
    binary = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + np.arange(6, dtype="<f4").tobytes()
    p = sources.parse_ply(binary)
    assert p[["x", "y", "z"]].to_numpy().ravel().tolist() == [0, 1, 2, 3, 4, 5] and (p["r"] == 0).all()


def test_keyframes_of_a_recording(spark):
    eye = [float(i == j) for i in range(4) for j in range(4)]
    moved = eye[:3] + [2.0] + eye[4:]
    rows = [("r", None, datetime(2024, 1, 1) + timedelta(seconds=i), 0.001, [1.0], None if i == 6 else moved, i % 2 == 0, i != 3, True, 1, 1) for i in range(12)]
    f = spark.createDataFrame(rows, sources.FRAMES)
    kf = sources.keyframes(f, warmup=2, most=3).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in kf] == [2, 3, 7] or len(kf) <= 3
    assert kf[0].t_wc[3] == -2.0
    assert sources.first_valid_frame(f, 3).first().ts == datetime(2024, 1, 1, 0, 0, 4)


def test_debug_views(spark):
    px = spark.createDataFrame([(1, u, 0, 10 * u, 100, 100, 100) for u in range(4)], "fid int, u int, v int, depth_u16 int, r int, g int, b int")
    grey = [r.grey for r in sinks.depth_view(px, ["fid"]).orderBy("u").collect()]
    assert grey[1] == 0 and grey[3] == 254 and grey[0] == 0
    masks = spark.createDataFrame([(1, 1, 2, 0), (1, 2, 3, 0)], "fid int, mask_id int, u int, v int")
    o = {r.u: (r.r, r.g, r.b) for r in sinks.overlay(px, masks, ["fid"]).collect()}
    assert o[0] == (100, 100, 100) and o[2] == (65, 154, 65) and o[3] == (154, 154, 65)
    assert {(r.mask_id, r.u) for r in sinks.mask_labels(masks, ["fid"]).collect()} == {(1, 2), (2, 3)}
    view = sinks.projection_view(px.select("fid", F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y")), ["fid"], "x", "y").collect()
    assert min(r.px for r in view) == 20 and max(r.px for r in view) == 492 and {r.py for r in view} == {492} and all(r.drawn for r in view)


def test_geometry_columns_hold_all_parameters():
    g = shapes.pack({"shape": "sphere", "confidence": "low", "allow_upgrade": True, "allow_downgrade": True, "params": {"diameter": 0.1, "center": [0, 1, 2]}})
    assert g["diameter"] == 0.1 and g["radius"] is None and '"center": [0, 1, 2]' in g["params"]
