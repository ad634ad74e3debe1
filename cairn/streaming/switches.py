"""Confirmed switches of a label: what a track is taken for changes only when another label was seen often enough in a row.

A track keeps its label until a sure observation of another one comes `times` times without the kept one between; an unsure observation of
another label is passed over. This is a fold over a track's observations in order, but not one that needs them in one place: the rows are
dealt by ranges of (track, order), so a track with a third of all rows is spread over many tasks. Within a range every track but the first
begins there, so its state is known and it is folded at once. The first may go on from the range before, so its rows are summed up as a
transition map, from every state that it may come with to the state that it leaves with. Maps compose; there is one for each range at most, and when they
have been chained in order the states between them are known and the rows that waited are folded range by range.

A map has at most (b + 1) * (1 + (b + 1) * (times - 1)) + 1 entries for the b labels of its range: labels are meant to be few. Rows without a
track, an order or a label are no observations, nor are rows that are not newer than the last one of their track in the given states: both come
back as rejected. Observations of one track with equal order are taken by label.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: What a track is after its observations; `last` is the order of the last one.
STATE = "shape string, pending string, pending_count int, switches long, obs_count long, last long"
EVENT = "order long, event string, label string, shape string, pending_count int, obs_count long"

#: In a map: the label, and the pending label, that a track came with, when neither was seen in the range.
_SHAPE, _PENDING = 0, 1
_Label = str | int | None
_State = tuple[_Label, _Label, int]


class Advanced(NamedTuple):
    """What advance() returns: the log, the states of the tracks that were observed, and the rows that were no observations with `reason`."""

    events: DataFrame
    states: DataFrame
    rejected: DataFrame


def step(state: _State, label: str, sure: bool, times: int) -> tuple[_State, str]:
    """The state after an observation and what it did."""
    shape, pending, count = state
    if shape is None:
        return (label, None, 0), "init"
    if label == shape:
        return (shape, None, 0), "same_shape"
    if not sure:
        return state, "not_sure_enough"
    count = count + 1 if pending == label else 1
    return ((label, None, 0), "switch_confirmed") if count >= times else ((shape, label, count), "pending_update")


class Sweep:
    """The transition map of a range of observations. States that have come together stay together, so that few of them are moved."""

    def __init__(self, times: int):
        self.times, self.seen = times, set()
        self.came: list[_State] = [(None, None, 0), (_SHAPE, None, 0), *((_SHAPE, _PENDING, n) for n in range(1, times))]
        self.switches = [0] * len(self.came)
        self.groups: dict[_State, list[int]] = {s: [i] for i, s in enumerate(self.came)}

    def _meet(self, label: str) -> None:
        """A label is seen for the first time: a track that came with it parts from those that came with another."""
        self.seen.add(label)
        for (shape, pending, count), ids in list(self.groups.items()):
            for i in list(ids):
                was, waited, n = self.came[i]
                for came, now in (((label, waited, n), (label if shape == _SHAPE else shape, pending, count)), ((was, label, n), (shape, label if pending == _PENDING else pending, count))):
                    if (came[0] == label and was == _SHAPE) or (came[1] == label and waited == _PENDING):
                        self.came.append(came)
                        self.switches.append(self.switches[i])
                        self.groups.setdefault(now, []).append(len(self.came) - 1)

    def see(self, label: str, sure: bool) -> None:
        if label not in self.seen:
            self._meet(label)
        moved: dict[_State, list[int]] = {}
        for state, ids in self.groups.items():
            now, what = step(state, label, sure, self.times)
            if what == "switch_confirmed":
                for i in ids:
                    self.switches[i] += 1
            moved[now] = moved[now] + ids if now in moved else ids
        self.groups = moved

    def entries(self) -> list[list]:
        return [[*self.came[i], *state, self.switches[i]] for state, ids in self.groups.items() for i in ids]


def through(entries: list[list], state: _State) -> tuple[_State, int]:
    """Where a map takes a state, and over how many switches."""
    table = {tuple(e[:3]): e[3:] for e in entries}
    labels = {x for e in entries for x in e[:2] if isinstance(x, str)}
    shape, pending, count = state
    s, p, n, switches = table[(None if shape is None else shape if shape in labels else _SHAPE, None if pending is None else pending if pending in labels else _PENDING, count)]
    return (shape if s == _SHAPE else s, pending if p == _PENDING else p, n), switches


class _Fold:
    """Folds one track's observations from a known state and tells what happened."""

    def __init__(self, state: _State, switches: int, obs: int, last: int | None, times: int, told: frozenset[str]):
        self.state, self.switches, self.obs, self.last, self.times, self.told = state, switches, obs, last, times, told

    def see(self, order: int, label: str, sure: bool) -> Iterator[tuple]:
        was = self.state[0]
        self.state, what = step(self.state, label, sure, self.times)
        self.obs, self.last = self.obs + 1, order
        if what == "init":
            if "init" in self.told:
                yield order, "init", label, label, 0, self.obs
            return
        if "infer" in self.told:
            yield order, "infer", label, was, self.state[2], self.obs
        if what in ("pending_update", "switch_confirmed") and "pending_update" in self.told:
            yield order, "pending_update", label, was, self.times if what == "switch_confirmed" else self.state[2], self.obs
        if what == "switch_confirmed":
            self.switches += 1
            if "switch_confirmed" in self.told:
                yield order, "switch_confirmed", label, label, 0, self.obs


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_CAME = ["c_shape", "c_pending", "c_pending_count", "c_switches", "c_obs_count", "c_last"]
_PASS = f"block int, kind string, sure boolean, {EVENT}, c_shape string, c_pending string, c_pending_count int, c_switches long, c_obs_count long, c_last long, map string"


def _table(keys: Sequence[str], kinds: Sequence[pa.DataType], names: Sequence[str], types: Sequence[pa.DataType], rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (len(keys) + len(names))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, *types], strict=True)], names=[*keys, *names])


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _types(schema: str) -> list[pa.DataType]:
    return [_ARROW[x.split()[1]] for x in schema.split(", ")]


def advance(rows: DataFrame, keys: Sequence[str], times: int = 3, states: DataFrame | None = None, told: Iterable[str] = ("init", "infer", "pending_update", "switch_confirmed")) -> Advanced:
    """Folds observations (keys, order long, label string, sure boolean) into tracks, which go on from `states` (keys, STATE) where they have one.

    Events are told as they are named: init and infer with the label that was seen and the shape that was held, pending_update with its count,
    switch_confirmed with the new shape.
    """
    keys, told, n = list(keys), frozenset(told), len(keys)
    key_schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    base = states if states is not None else rows.sparkSession.createDataFrame([], f"{key_schema}, {STATE}")
    came = base.select(*keys, *[F.col(a).alias(b) for a, b in zip(_names(STATE), _CAME, strict=True)])
    whole = F.col("order").isNotNull() & F.col("label").isNotNull()
    for k in keys:
        whole = whole & F.col(f"`{k}`").isNotNull()
    seen = rows.select(*keys, "order", "label", F.coalesce("sure", F.lit(False)).alias("sure")).join(came, keys, "left")
    reason = F.when(~whole, "null").when(F.col("order") <= F.col("c_last"), "late")
    rejected = seen.withColumn("reason", reason).filter("reason IS NOT NULL").select(*keys, "order", "label", "sure", "reason")
    dealt = [*keys, "order", "label"]
    ranges = seen.filter(reason.isNull()).repartitionByRange(*dealt).sortWithinPartitions(*dealt, "sure")
    names, types = _names(_PASS), _types(_PASS)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, now, fold, sweep, size, given = TaskContext.get().partitionId(), None, None, None, 0, None
        out: list[tuple] = []

        def ended() -> Iterator[tuple]:
            if sweep is not None:
                yield *now, block, "map", None, given[5], None, None, None, None, size, *given, json.dumps(sweep.entries())
            elif fold is not None:
                yield *now, block, "exit", None, fold.last, None, None, fold.state[0], None, None, fold.state[0], fold.state[1], fold.state[2], fold.switches, fold.obs, fold.last, None

        for b in batches:
            kinds = [b.schema.field(k).type for k in keys]
            for row in zip(*(b[c].to_pylist() for c in (*keys, "order", "label", "sure", *_CAME)), strict=True):
                key, (order, label, sure), state = row[:n], row[n : n + 3], row[n + 3 :]
                if key != now:
                    out += ended()
                    first, now, given, size = now is None, key, state, 0
                    sweep = Sweep(times) if first else None
                    fold = None if first else _Fold((state[0], state[1], state[2] or 0), state[3] or 0, state[4] or 0, state[5], times, told)
                if sweep is not None:
                    sweep.see(label, sure)
                    size, given = size + 1, (*given[:5], order)
                    out.append((*key, block, "row", sure, order, None, label, None, None, None, *[None] * 6, None))
                else:
                    out += [(*key, block, "event", None, *e, *[None] * 6, None) for e in fold.see(order, label, sure)]
            yield _table(keys, kinds, names, types, out)
            out = []
        if now is not None:
            yield _table(keys, kinds, names, types, ended())

    table = cut(ranges.mapInArrow(first_pass, f"{key_schema}, {_PASS}"))
    maps = table.filter("kind = 'map'")
    spread = maps.select(*keys).distinct()  # one track a range at most
    chain = table.filter("kind IN ('map', 'exit')").join(spread, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "block")
    passed = f"{key_schema}, block int, {STATE}, done boolean"

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, out, kinds = None, None, [], None
        types_ = [pa.int32(), *_types(STATE), pa.bool_()]

        def tell(block: int | None, done: bool) -> tuple:
            return *now, block, *fold, done

        for b in batches:
            kinds = [b.schema.field(k).type for k in keys]
            for row in zip(*(b[c].to_pylist() for c in (*keys, "block", "kind", "order", "obs_count", *_CAME, "map")), strict=True):
                key, (block, kind, last, size), state, entries = row[:n], row[n : n + 4], row[n + 4 : n + 10], row[n + 10]
                if key != now:
                    if now is not None:
                        out.append(tell(None, True))
                    now, fold = key, (state[0], state[1], state[2] or 0, state[3] or 0, state[4] or 0, None)
                if kind == "map":
                    out.append(tell(block, False))
                    (shape, pending, count), switches = through(json.loads(entries), fold[:3])
                    fold = (shape, pending, count, fold[3] + switches, fold[4] + size, last)
                else:
                    fold = state
            yield _table(keys, kinds, ["block", *_names(STATE), "done"], types_, out)
            out = []
        if now is not None:
            yield _table(keys, kinds, ["block", *_names(STATE), "done"], types_, [tell(None, True)])

    links = cut(chain.mapInArrow(chained, passed))
    exits = table.filter("kind = 'exit'").join(spread, keys, "left_anti").select(*keys, *[F.col(c).alias(s) for c, s in zip(_CAME, _names(STATE), strict=True)])
    final = exits.unionByName(links.filter("done").select(*keys, *_names(STATE)))

    waiting = table.filter("kind = 'row'").select(*keys, "block", "order", "label", "sure")
    waiting = waiting.join(links.filter("NOT done").drop("done"), [*keys, "block"]).repartition(*keys, "block").sortWithinPartitions(*keys, "block", "order", "label", "sure")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for b in batches:
            kinds, out = [b.schema.field(k).type for k in keys], []
            for row in zip(*(b[c].to_pylist() for c in (*keys, "block", "order", "label", "sure", *_names(STATE))), strict=True):
                at, (order, label, sure), state = row[: n + 1], row[n + 1 : n + 4], row[n + 4 :]
                if at != now:
                    now, fold = at, _Fold(state[:3], state[3], state[4], None, times, told)
                out += [(*at[:n], *e) for e in fold.see(order, label, sure)]
            yield _table(keys, kinds, _names(EVENT), _types(EVENT), out)

    later = waiting.mapInArrow(second_pass, f"{key_schema}, {EVENT}")
    events = table.filter("kind = 'event'").select(*keys, *_names(EVENT)).unionByName(later)
    return Advanced(events, final, rejected)


def latest(states: DataFrame, keys: Sequence[str], version: str | Column) -> DataFrame:
    """(keys, STATE): the state of the highest version of every track."""
    names = _names(STATE)
    return states.groupBy(*keys).agg(F.max_by(F.struct(*names), version).alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in names])
