"""Confirmed switches: folds over ranges and transition maps against a plain fold."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.streaming import switches
from cairn.streaming.switches import Sweep, advance, step, through

SCHEMA = "k string, order long, label string, sure boolean"
seen = st.lists(st.tuples(st.sampled_from("abcd"), st.booleans()), max_size=14)


def plain(rows, times=3):
    """States and events of rows (key, order, label, sure), one after the other."""
    states, events = {}, []
    for k, order, label, sure in sorted(rows):
        (shape, pending, n), switched, obs, _ = states.get(k, ((None, None, 0), 0, 0, None))
        obs += 1
        if shape is None:
            shape = label
            events.append((k, order, "init", label, label, 0, obs))
        elif label == shape:
            pending, n = None, 0
            events.append((k, order, "infer", label, shape, 0, obs))
        else:
            was = shape
            if sure:
                n = n + 1 if pending == label else 1
                pending = label
                waits = n
                if n >= times:
                    shape, pending, n, switched = label, None, 0, switched + 1
                events.append((k, order, "pending_update", label, was, waits, obs))
                if shape == label:
                    events.append((k, order, "switch_confirmed", label, label, 0, obs))
            events.append((k, order, "infer", label, was, n, obs))
        states[k] = ((shape, pending, n), switched, obs, order)
    return states, sorted(events)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def stand(df):
    return {r.k: ((r.shape, r.pending, r.pending_count), r.switches, r.obs_count, r.last) for r in df.collect()}


@settings(max_examples=300, deadline=None)
@given(seen, seen, st.integers(1, 4))
def test_a_map_takes_every_state_where_its_rows_do(before, inside, times):
    state, sweep = (None, None, 0), Sweep(times)
    for label, sure in before:
        state, _ = step(state, label, sure, times)
    for label, sure in inside:
        sweep.see(label, sure)
    want, switched = state, 0
    for label, sure in inside:
        want, what = step(want, label, sure, times)
        switched += what == "switch_confirmed"
    assert through(sweep.entries(), state) == (want, switched)


@pytest.fixture
def apart(spark):
    """Keeps small ranges apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _rows(n, seed=3):
    pick = random.Random(seed)
    return [("hot" if pick.random() < 0.7 else f"k{pick.randrange(6)}", i, pick.choice("aaabbbccd") if i % 40 else f"new{i}", pick.random() < 0.8) for i in range(n)]


def test_a_hot_track_over_all_ranges(spark, apart):
    rows = _rows(1500)
    got = advance(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"])
    states, events = plain(rows)
    assert told(got.events) == events and stand(got.states) == states and got.rejected.isEmpty()


def test_runs_go_on_from_states(spark, apart):
    rows = _rows(900)
    first = advance(spark.createDataFrame([r for r in rows if r[1] < 400], SCHEMA), ["k"])
    second = advance(spark.createDataFrame([r for r in rows if r[1] >= 350], SCHEMA), ["k"], states=first.states)
    states, events = plain(rows)
    assert sorted(told(first.events) + told(second.events)) == events
    assert stand(first.states) | stand(second.states) == states
    assert {(r.k, r.order) for r in second.rejected.collect()} <= {r[:2] for r in rows if 350 <= r[1] < 400} and second.rejected.count() == 50
    assert {r.reason for r in second.rejected.collect()} == {"late"}


def test_odd_rows(spark):
    rows = [("a", 1, "x", True), ("a", 1, "x", True), ("a", 1, "y", None), (None, 1, "x", True), ("a", None, "x", True), ("b", 2, None, True), ("c", 5, "x", False)]
    got = advance(spark.createDataFrame(rows, SCHEMA), ["k"])
    assert stand(got.states) == {"a": (("x", None, 0), 0, 3, 1), "c": (("x", None, 0), 0, 1, 5)}
    assert sorted(r.reason for r in got.rejected.collect()) == ["null"] * 3
    none = advance(spark.createDataFrame([], SCHEMA), ["k"])
    assert none.events.isEmpty() and none.states.isEmpty() and none.rejected.isEmpty()


def test_several_key_columns_and_chosen_events(spark):
    rows = [(1, "p", i, "ab"[i > 2], True) for i in range(9)] + [(1, "q", i, "a", True) for i in range(4)]
    got = advance(spark.createDataFrame(rows, "rec int, part string, order long, label string, sure boolean"), ["rec", "part"], 2, told=("switch_confirmed",))
    assert told(got.events) == [(1, "p", 4, "switch_confirmed", "b", "b", 0, 5)]
    assert {(r.rec, r.part): r.shape for r in switches.latest(got.states.selectExpr("*", "1 AS v"), ["rec", "part"], "v").collect()} == {(1, "p"): "b", (1, "q"): "a"}
