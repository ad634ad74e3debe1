"""Tracks as keyed state: identities by recording, clouds and geometry by track, so that a batch rewrites only what it saw.

Two stateful steps follow each other. The first, keyed by recording, knows the templates of a recording (or the running centres of its tracks) and
gives every observed object its identity; that is a few numbers a track. The second, keyed by recording and track, keeps the track's points as a list that
is only appended to (or, with a voxel, thinned to one point a voxel), and the state of its geometry. Both run as transformWithState over a stream and as grouped
maps over a table, through the same functions, so stream and batch agree. A timer clears what belongs to a recording that has been silent for `idle_ms`;
it needs a query that keeps running, as one that ends with what is there (availableNow) would wait for its timers without an end.

Events tell what happened to an object: late, too_few_raw_points, global_id_is_minus_one, not_in_allowed_global_ids, too_few_points, init, updated; and after an update
the track's history: infer with the candidate, pending_update with its count, switch_confirmed with the new shape.

Streams need the RocksDB state store: spark.sql.streaming.stateStore.providerClass = ROCKSDB.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import StateConfig
from ..functions import shapes
from ..functions.split import denoise, voxel_mean
from .tracks import SEEN, Track, _first_geometry, _rows, assign, confirm, signature

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What the first step passes on: a usable object with its identity, or the event that ended it.
NAMED = f"rec_id string, global_id int, keyframe_index int, local_id int, event string, x array<double>, y array<double>, z array<double>, r double, g double, b double, {SEEN}"
HISTORY = "rec_id string, global_id int, keyframe_index int, local_id int, event string, obs_count int, points long, shape string, confidence string, pending_count int, candidate string, candidate_confidence string, params string"
META = "obs_count int, last_seen int, r double, g double, b double, geometry string, pending string, pending_count int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _plain(x):
    """A geometry in values that JSON has."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple | np.ndarray):
        return [_plain(v) for v in x]
    return x.item() if isinstance(x, np.generic) else x


class Recording:
    """Identities within a recording. known: by identity the signature of its template, or the sum and number of its track's points."""

    def __init__(self, last: int | None, known: dict[int, list[float]], cfg: StateConfig, fixed: bool, allowed: frozenset[int] | None):
        self.last, self.known, self.cfg, self.fixed, self.allowed = last, known, cfg, fixed, allowed
        self.changed: set[int] = set()

    def _nearest(self, row: dict) -> int:
        at = row["points"].mean(axis=0)
        far = {g: float(np.linalg.norm(np.array(s[:3]) / s[3] - at)) for g, s in self.known.items()}
        g = min(far, key=lambda k: (far[k], k), default=0)
        if not g or far[g] >= self.cfg.match_distance:
            g = len(self.known) + 1
        p = denoise(row["points"], self.cfg.voxel, self.cfg.neighbours, self.cfg.std_ratio, "all")
        if g not in self.known or len(p) >= self.cfg.min_points:
            self.known[g] = (np.array(self.known.get(g, [0.0] * 4)) + [*p.sum(axis=0), len(p)]).tolist()
            self.changed.add(g)
        return g

    def name(self, keyframe: int, rows: list[dict]) -> Iterator[tuple[dict, int, str | None]]:
        """Each object of a keyframe with its identity and, if it goes no further, the reason."""
        if self.last is not None and keyframe <= self.last:
            yield from ((row, -1, "late") for row in rows)
            return
        self.last = keyframe
        rows = sorted(rows, key=lambda r: r["local_id"])
        usable = [r for r in rows if len(r["points"]) >= self.cfg.min_points]
        yield from ((r, -1, "too_few_raw_points") for r in rows if len(r["points"]) < self.cfg.min_points)
        if self.fixed and not self.known:
            self.known = {i: signature(r["points"], r["colour"]).tolist() for i, r in enumerate(usable, 1)}
            self.changed |= set(self.known)
            ids = list(self.known)
        elif self.fixed:
            ids = assign({g: np.array(s) for g, s in self.known.items()}, [signature(r["points"], r["colour"]) for r in usable], self.cfg.match_distance)
        else:
            ids = [self._nearest(r) for r in usable]
        for row, g in zip(usable, ids, strict=True):
            yield row, g, "global_id_is_minus_one" if g < 0 else None if self.allowed is None or g in self.allowed else "not_in_allowed_global_ids"

    def rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """NAMED rows of OBSERVATION rows of this recording."""
        out, rec = [], pdf["rec_id"].iloc[0]
        for keyframe, rows in _rows(pdf):
            for row, g, event in self.name(keyframe, rows):
                seen = row["seen"]
                keep = {c: None if event else getattr(seen, c, None) for c in ("x", "y", "z", *_names(SEEN))}
                out.append({"rec_id": rec, "global_id": g, "keyframe_index": keyframe, "local_id": row["local_id"], "event": event, "r": seen.r, "g": seen.g, "b": seen.b} | keep)
        return pd.DataFrame(out, columns=_names(NAMED))


def _track(meta: tuple | None, points: np.ndarray) -> Track | None:
    if meta is None:
        return None
    n, last, r, g, b, geometry, pending, count = meta
    return Track(points, np.array([r, g, b]), n, last, json.loads(geometry), None, json.loads(pending) if pending else None, count)


def _meta(t: Track) -> tuple:
    return t.obs_count, t.last_seen, *map(float, t.colour), json.dumps(t.geometry), json.dumps(t.pending) if t.pending else None, t.pending_count


def follow(t: Track | None, pdf: pd.DataFrame, cfg: StateConfig, voxel: float) -> tuple[Track | None, np.ndarray | None, list[dict]]:
    """A track after NAMED rows of its own, the points that are to be appended (None: all are to be written anew), and what happened."""
    out, added = [], [np.zeros((0, 3))]

    def tell(keyframe: int, local_id: int, event: str, track: Track | None, candidate: dict | None = None, held: dict | None = None, count: int | None = None) -> None:
        held = held or (track.geometry if track else None) or {}
        out.append(
            {"rec_id": pdf["rec_id"].iloc[0], "global_id": int(pdf["global_id"].iloc[0]), "keyframe_index": keyframe, "local_id": local_id, "event": event, "obs_count": track.obs_count if track else 0, "points": len(track.points) if track else 0}
            | {"shape": held.get("shape"), "confidence": held.get("confidence"), "params": json.dumps(held["params"], sort_keys=True) if held else None, "pending_count": count if count is not None else track.pending_count if track else 0}
            | {"candidate": candidate and candidate["shape"], "candidate_confidence": candidate and candidate["confidence"]}
        )

    pdf = pdf.sort_values(["keyframe_index", "local_id"])
    for r in pdf[pdf["event"].notna()].itertuples():
        tell(int(r.keyframe_index), int(r.local_id), r.event, None)
    for keyframe, rows in _rows(pdf[pdf["event"].isna()]):
        for row in rows:
            p, colour, i = denoise(row["points"], cfg.voxel, cfg.neighbours, cfg.std_ratio, "all"), row["colour"], row["local_id"]
            if t is None:
                t = Track(p, colour, 1, keyframe, _plain(_first_geometry(row, p, cfg)))
                added.append(p)
                tell(keyframe, i, "init", t)
                continue
            if len(p) < cfg.min_points:
                tell(keyframe, i, "too_few_points", t)
                continue
            n = t.obs_count
            t.points, t.colour = np.vstack([t.points, p]), (t.colour * n + colour) / (n + 1)
            added.append(p)
            if voxel:
                t.points = voxel_mean(t.points, voxel)
            t.obs_count, t.last_seen = n + 1, keyframe
            tell(keyframe, i, "updated", t)
            candidate = _candidate(t, cfg)
            if candidate is None:
                continue
            tell(keyframe, i, "infer", t, candidate)
            held, what = t.geometry, confirm(t, candidate, cfg.confirmations, cfg.least_confidence)
            if what in ("pending_update", "switch_confirmed"):
                tell(keyframe, i, "pending_update", t, candidate, held, cfg.confirmations if what == "switch_confirmed" else t.pending_count)
            if what == "switch_confirmed":
                tell(keyframe, i, "switch_confirmed", t, candidate)
    return t, None if voxel else np.vstack(added), out


def _candidate(t: Track, cfg: StateConfig) -> dict | None:
    """The geometry that the track's points speak for, if they are enough."""
    if t.geometry is None or len(t.points) < max(cfg.geometry_min_accumulated, cfg.min_points):
        return None
    least = max(cfg.geometry_min_points, cfg.min_points)
    p = denoise(t.points, cfg.voxel, cfg.geometry_neighbours, cfg.std_ratio, "all")
    return _plain(shapes.infer(p, t.geometry, least)) if len(p) >= least else None


class _Timed(StatefulProcessor):
    """Clears a key's state when it has been silent for a while."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> list:
        raise NotImplementedError

    def wake(self, timers) -> None:
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for s in self.states:
            s.clear()
        return iter(())

    def close(self) -> None:
        pass


class RecordingProcessor(_Timed):
    """Gives objects their identity; keyed by recording."""

    def __init__(self, cfg: StateConfig, fixed: bool, allowed: frozenset[int] | None, idle_ms: int | None):
        super().__init__(idle_ms)
        self.cfg, self.fixed, self.allowed = cfg, fixed, allowed

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.last = handle.getValueState("last", "last int")
        self.known = handle.getMapState("known", "global_id int", "value array<double>")
        return [self.last, self.known]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        known = {int(k[0]): [float(x) for x in v[0]] for k, v in self.known.iterator()} if last is not None else {}
        rec = Recording(last, known, self.cfg, self.fixed, self.allowed)
        out = rec.rows(pd.concat(list(rows)))
        for g in sorted(rec.changed):
            self.known.updateValue((g,), (rec.known[g],))
        if rec.last is not None:
            self.last.update((rec.last,))
        self.wake(timerValues)
        yield out


class TrackProcessor(_Timed):
    """Accumulates clouds and follows geometry; keyed by recording and identity."""

    def __init__(self, cfg: StateConfig, voxel: float, idle_ms: int | None):
        super().__init__(idle_ms)
        self.cfg, self.voxel = cfg, voxel

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.meta = handle.getValueState("meta", META)
        self.points = handle.getListState("points", "x double, y double, z double")
        return [self.meta, self.points]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        meta = tuple(self.meta.get()) if self.meta.exists() else None
        held = np.array([tuple(p) for p in self.points.get()], float).reshape(-1, 3) if meta else np.zeros((0, 3))
        t, added, out = follow(_track(meta, held), pd.concat(list(rows)), self.cfg, self.voxel)
        if t is not None:
            self.meta.update(_meta(t))
            if added is None:
                self.points.put([tuple(map(float, p)) for p in t.points])
            elif len(added):
                self.points.appendList([tuple(map(float, p)) for p in added])
        self.wake(timerValues)
        yield pd.DataFrame(out, columns=_names(HISTORY))


def _complete(observations: DataFrame) -> DataFrame:
    """Observations with the columns of SEEN, null where they are missing."""
    for name, kind in (c.split(" ") for c in SEEN.split(", ")):
        if name not in observations.columns:
            observations = observations.withColumn(name, F.lit(None).cast(kind))
    return observations


def history_stream(observations: DataFrame, cfg: StateConfig | None = None, fixed: bool = True, voxel: float = 0.0, allowed: frozenset[int] | None = None, idle_ms: int | None = None) -> DataFrame:
    """HISTORY of a stream of OBSERVATION rows. Keyframes of a recording come in ascending order over batches; within one they are put in order."""
    cfg = cfg or StateConfig()
    mode = "ProcessingTime" if idle_ms is not None else "None"
    named = _complete(observations).groupBy("rec_id").transformWithStateInPandas(RecordingProcessor(cfg, fixed, allowed, idle_ms), NAMED, "Append", mode)
    return named.groupBy("rec_id", "global_id").transformWithStateInPandas(TrackProcessor(cfg, voxel, idle_ms), HISTORY, "Append", mode)


def history_batch(observations: DataFrame, cfg: StateConfig | None = None, fixed: bool = True, voxel: float = 0.0, allowed: frozenset[int] | None = None) -> DataFrame:
    """history_stream() of a table. A recording's keyframes are bounded by its source."""
    cfg = cfg or StateConfig()
    named = _complete(observations).groupBy("rec_id").applyInPandas(lambda pdf: Recording(None, {}, cfg, fixed, allowed).rows(pdf), NAMED)
    return named.groupBy("rec_id", "global_id").applyInPandas(lambda pdf: pd.DataFrame(follow(None, pdf, cfg, voxel)[2], columns=_names(HISTORY)), HISTORY)
