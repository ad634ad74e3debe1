"""Tracks of objects over keyframes: association, accumulation and confirmed geometry, as one ordered fold for batch and stream.

State is kept by recording. Keyframes of a recording come in ascending order; rows of a keyframe that isn't newer than the last one
folded are reported as `late` and change nothing. Points of a track grow with its observations unless `voxel` thins them.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import StateConfig
from ..functions import shapes
from ..functions.split import denoise, voxel_mean

#: One row of input is one observed object: its points in the reference frame as three equally long arrays. Its points in the camera frame and its
#: mask's pixels, for the first geometry, may follow.
OBSERVATION = "rec_id string, keyframe_index int, local_id int, x array<double>, y array<double>, z array<double>, r double, g double, b double"
SEEN = "cx array<double>, cy array<double>, cz array<double>, mu array<int>, mv array<int>"
EVENT = "rec_id string, keyframe_index int, local_id int, global_id int, event string, obs_count int, points long, shape string, confidence string, pending_count int, params string"


@dataclass
class Track:
    points: np.ndarray
    colour: np.ndarray
    obs_count: int = 1
    last_seen: int = 0
    geometry: dict | None = None
    first: dict | None = None
    pending: dict | None = None
    pending_count: int = 0

    def signature(self) -> np.ndarray:
        """Median centre, robust extent and colour."""
        return signature(self.points, self.colour)


@dataclass
class State:
    tracks: dict[int, Track] = field(default_factory=dict)
    templates: dict[int, np.ndarray] = field(default_factory=dict)
    last: int | None = None


def signature(p: np.ndarray, colour: np.ndarray) -> np.ndarray:
    lo, hi = np.quantile(p, [0.05, 0.95], axis=0)
    return np.concatenate([np.median(p, axis=0), hi - lo, colour])


def assign(templates: dict[int, np.ndarray], seen: list[np.ndarray], gate: float) -> list[int]:
    """The template of each object, -1 for none: pairs within the gate by cost, cheapest first, every template and object once.

    The cost is the distance of the centres, then the differences of extent and colour at a tenth of their weight; ties go to the lower
    template and then to the earlier object.
    """
    pairs = []
    for g, t in templates.items():
        for i, s in enumerate(seen):
            d = float(np.linalg.norm(t[:3] - s[:3]))
            if d < gate:
                pairs.append((d + 0.1 * float(np.linalg.norm(t[3:6] - s[3:6])) + 0.1 * gate * float(np.linalg.norm(t[6:] - s[6:])), g, i))
    out, used = [-1] * len(seen), set()
    for _, g, i in sorted(pairs):
        if g not in used and out[i] < 0:
            out[i] = g
            used.add(g)
    return out


def confirm(track: Track, candidate: dict, times: int, least: str = "medium") -> str:
    """Folds a candidate geometry into a track and says what it did.

    The same shape replaces the geometry unless it is less sure, and clears what was pending. Another shape must be sure enough, else
    it is passed over without clearing anything; it switches when it was the pending one `times` times.
    """
    rank = shapes.RANK
    if candidate["shape"] == track.geometry["shape"]:
        if rank[candidate["confidence"]] >= rank[track.geometry["confidence"]]:
            track.geometry = candidate
        track.pending, track.pending_count = None, 0
        return "same_shape"
    if rank[candidate["confidence"]] < rank[least]:
        return "not_sure_enough"
    again = track.pending is not None and track.pending["shape"] == candidate["shape"]
    track.pending, track.pending_count = candidate, track.pending_count + 1 if again else 1
    if track.pending_count < times:
        return "pending_update"
    track.geometry, track.pending, track.pending_count = candidate, None, 0
    return "switch_confirmed"


def _update_geometry(track: Track, cfg: StateConfig) -> str | None:
    if track.geometry is None or len(track.points) < max(cfg.geometry_min_accumulated, cfg.min_points):
        return None
    least = max(cfg.geometry_min_points, cfg.min_points)
    p = denoise(track.points, cfg.voxel, cfg.geometry_neighbours, cfg.std_ratio, "all")
    if len(p) < least:
        return None
    return confirm(track, shapes.infer(p, track.geometry, least), cfg.confirmations, cfg.least_confidence)


def ignore_reason(global_id: Column, allowed: Column) -> Column:
    """Why an assigned object is passed over: no identity, or one that isn't allowed; null for one that is kept."""
    return F.when(global_id < 0, "global_id_is_minus_one").when(~allowed, "not_in_allowed_global_ids")


def existing(objects: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Objects that have a point."""
    return objects.join(points.select(*keys), keys, "left_semi")


def _first_geometry(row: dict, p: np.ndarray, cfg: StateConfig) -> dict:
    """From the camera-frame cloud and the mask where they were observed and the cloud is large enough; else from the reference-frame cloud."""
    cam, mask = row.get("cam"), row.get("mask")
    if cam is not None and mask is not None and len(cam) >= 50:
        return shapes.initial(denoise(cam, cfg.voxel, cfg.neighbours, cfg.std_ratio, "all"), mask)
    return shapes.initial(p, None)


def fold_keyframe(state: State, rec: str, keyframe: int, rows: list[dict], cfg: StateConfig, fixed: bool, voxel: float, allowed: frozenset[int] | None = None) -> list[dict]:
    """Events of one keyframe's objects, which the state then holds.

    fixed: the first keyframe's objects are the only templates, later ones get one of them or -1. Otherwise an object joins the nearest
    track within the gate, or begins a new one; several objects of a keyframe may join one track, whose centre moves after each. allowed: the
    identities that are followed, all if None.
    """
    out = []

    def tell(row: dict, g: int, event: str) -> None:
        t = state.tracks.get(g)
        geometry = (t.geometry if t else None) or {}
        out.append({"rec_id": rec, "keyframe_index": keyframe, "local_id": row["local_id"], "global_id": g, "event": event, "obs_count": t.obs_count if t else 0, "points": len(t.points) if t else 0, "shape": geometry.get("shape"), "confidence": geometry.get("confidence"), "pending_count": t.pending_count if t else 0, "params": json.dumps(geometry["params"], sort_keys=True, default=float) if geometry else None})

    if state.last is not None and keyframe <= state.last:
        for row in rows:
            tell(row, -1, "late")
        return out
    state.last = keyframe
    rows = sorted(rows, key=lambda r: r["local_id"])
    usable = [r for r in rows if len(r["points"]) >= cfg.min_points]
    for row in rows:
        if len(row["points"]) < cfg.min_points:
            tell(row, -1, "too_few_raw_points")
    if fixed and not state.templates:
        state.templates = {i + 1: signature(r["points"], r["colour"]) for i, r in enumerate(usable)}
        ids = list(state.templates)
    elif fixed:
        ids = assign(state.templates, [signature(r["points"], r["colour"]) for r in usable], cfg.match_distance)
    else:
        ids = [None] * len(usable)
    for row, g in zip(usable, ids, strict=True):
        p, colour = denoise(row["points"], cfg.voxel, cfg.neighbours, cfg.std_ratio, "all"), row["colour"]
        if g == -1:
            tell(row, -1, "global_id_is_minus_one")
            continue
        if g is None:
            centres = {k: float(np.linalg.norm(t.points.mean(axis=0) - row["points"].mean(axis=0))) for k, t in state.tracks.items()}
            g = min(centres, key=lambda k: (centres[k], k), default=0)
            if not g or centres[g] >= cfg.match_distance:
                g = len(state.tracks) + 1
        if allowed is not None and g not in allowed:
            tell(row, g, "not_in_allowed_global_ids")
            continue
        t = state.tracks.get(g)
        if t is None:
            first = _first_geometry(row, p, cfg)
            state.tracks[g] = Track(p, colour, 1, keyframe, first, first)
            tell(row, g, "init")
            continue
        if len(p) < cfg.min_points:
            tell(row, g, "too_few_points")
            continue
        n = t.obs_count
        t.points, t.colour = np.vstack([t.points, p]), (t.colour * n + colour) / (n + 1)
        if voxel:
            t.points = voxel_mean(t.points, voxel)
        t.obs_count, t.last_seen = n + 1, keyframe
        if fixed and cfg.update_templates:
            state.templates[g] = t.signature()
        tell(row, g, _update_geometry(t, cfg) or "updated")
    return out


def _rows(pdf: pd.DataFrame) -> Iterator[tuple[int, list[dict]]]:
    def row(r) -> dict:
        out = {"local_id": int(r.local_id), "points": _stacked(r.x, r.y, r.z), "colour": np.array([r.r, r.g, r.b], float), "seen": r}
        if getattr(r, "cx", None) is not None:
            out["cam"] = _stacked(r.cx, r.cy, r.cz)
        if getattr(r, "mu", None) is not None and len(r.mu):
            u, v = (np.asarray(c, int) - min(c) + 1 for c in (r.mu, r.mv))
            out["mask"] = np.zeros((v.max() + 2, u.max() + 2), bool)
            out["mask"][v, u] = True
        return out

    for keyframe, group in pdf.groupby("keyframe_index", sort=True):
        yield int(keyframe), [row(r) for r in group.itertuples()]


def _stacked(*columns) -> np.ndarray:
    return np.stack([np.asarray(c, float) for c in columns], axis=1).reshape(-1, 3)


def _columns() -> list[str]:
    return [c.split()[0] for c in EVENT.split(", ")]


def track_batch(observations: DataFrame, cfg: StateConfig | None = None, fixed: bool = True, voxel: float = 0.0, allowed: frozenset[int] | None = None) -> DataFrame:
    """Events of all observations, every recording folded in the order of its keyframes. A recording's keyframes are bounded by its source.

    Recordings are dealt by a fixed number of partitions: a fold takes long for its few bytes, by which Spark would put many in one task.
    """
    cfg, parts = cfg or StateConfig(), int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rec = State(), pdf["rec_id"].iloc[0]
        return pd.DataFrame([e for k, rows in _rows(pdf) for e in fold_keyframe(state, rec, k, rows, cfg, fixed, voxel, allowed)], columns=_columns())

    return observations.repartition(parts, "rec_id").groupBy("rec_id").applyInPandas(run, EVENT)


def track_stream(observations: DataFrame, cfg: StateConfig | None = None, fixed: bool = True, voxel: float = 0.0, allowed: frozenset[int] | None = None) -> DataFrame:
    """track_batch() over a stream: the state of a recording outlives micro-batches; within one its keyframes are put in order.

    By default all points are kept, as in the batch: a recording is bounded by its keyframe limit. Where there is no such limit, `voxel` bounds the
    state by the scene.
    """
    cfg = cfg or StateConfig()

    def run(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else State()
        pdf = pd.concat(list(frames))
        events = [e for k, rows in _rows(pdf) for e in fold_keyframe(held, key[0], k, rows, cfg, fixed, voxel, allowed)]
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(events, columns=_columns())

    return observations.groupBy("rec_id").applyInPandasWithState(run, EVENT, "state binary", "append", "NoTimeout")


def observations_of(points: DataFrame, camera: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """OBSERVATION rows of points with rec_id, keyframe_index, local_id, pid, x, y, z and r, g, b.

    camera: the same points in the camera frame; masks: (rec_id, keyframe_index, local_id, u, v). With either the SEEN columns follow.
    """
    keys = ["rec_id", "keyframe_index", "local_id"]
    cloud = lambda df, names: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pid", "x", "y", "z"))).alias("p"), *([F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("r", "g", "b")] if names == "xyz" else []))
    out = cloud(points, "xyz")
    out = out.select(*keys, *[F.col(f"p.{c}").alias(c) for c in ("x", "y", "z")], "r", "g", "b")
    if camera is None and masks is None:
        return out
    if camera is not None:
        out = out.join(cloud(camera, "c").select(*keys, *[F.col(f"p.{c}").alias(f"c{c}") for c in ("x", "y", "z")]), keys, "left")
    if masks is not None:
        px = masks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "u"))).alias("m"))
        out = out.join(px.select(*keys, F.col("m.u").cast("array<int>").alias("mu"), F.col("m.v").cast("array<int>").alias("mv")), keys, "left")
    for name, kind in (c.split(" ") for c in SEEN.split(", ")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def confirm_fold(candidates: Column, times: int = 3) -> Column:
    """confirm() as an expression over an ordered array of structs (shape, sure): a struct (shape, pending, count, switches) after the last."""
    start = F.struct(F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("pending"), F.lit(0).alias("count"), F.lit(0).alias("switches"))

    def step(s: Column, c: Column) -> Column:
        first, same = s["shape"].isNull(), s["shape"] == c["shape"]
        skip = ~c["sure"]
        n = F.when(s["pending"] == c["shape"], s["count"] + 1).otherwise(F.lit(1))
        switch = n >= times

        def result(shape, pending, count, switches) -> Column:
            return F.struct(shape.alias("shape"), pending.cast("string").alias("pending"), count.cast("int").alias("count"), switches.cast("int").alias("switches"))

        none, zero = F.lit(None), F.lit(0)
        return (
            F.when(first, result(c["shape"], none, zero, s["switches"]))
            .when(same, result(s["shape"], none, zero, s["switches"]))
            .when(skip, s)
            .when(switch, result(c["shape"], none, zero, s["switches"] + 1))
            .otherwise(result(s["shape"], c["shape"], n, s["switches"]))
        )

    return F.aggregate(candidates, start, step)
