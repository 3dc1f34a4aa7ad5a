"""State machines by composed functions against a loop over the events, with hot keys, nulls and refused events."""

import random

import numpy as np
import pytest

from chalkline.operators import lifecycle, machines, ops

SCHEMA = "course_id int, version_id int, action string, at long, seq long"


def test_prefixes_compose_in_order():
    rng = np.random.default_rng(0)
    maps, first = rng.integers(0, 5, (400, 5)).astype(np.uint8), rng.random(400) < 0.03
    first[0] = True
    out, held = machines.prefixes(maps, first), None
    for i, m in enumerate(maps):
        held = m if first[i] else m[held]
        assert (out[i] == held).all()


@pytest.mark.parametrize("size", [10**6, 40])
def test_machine(spark, monkeypatch, size):
    """``size`` 40: the hot key is in many ranges."""
    monkeypatch.setattr(machines, "RANGE_ROWS", size)
    rng = random.Random(size)
    moves = {"a": {0: 1, 1: 2}, "b": {2: 0, 1: 3}, "c": {3: 3, 0: 2}}
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}", i, rng.choice(["a", "b", "c", "d", None])) for i in range(600)]
    rng.shuffle(rows)
    found = machines.run_machine(spark.createDataFrame(rows, "k string, n int, what string"), ["k"], ["n"], "what", moves, 4).collect()
    state, expected = {}, {}
    for k, n, what in sorted(rows, key=lambda r: r[1]):
        before = state.get(k, 0)
        state[k] = moves.get(what, {}).get(before, before)
        expected[k, n, what] = before, state[k]
    assert len(found) == 600 and {(r.k, r.n, r.what): (r.state_before, r.state_after) for r in found} == expected
    assert machines.run_machine(spark.createDataFrame([], "k string, n int, what string"), ["k"], ["n"], "what", moves, 4).count() == 0


def history(rows):
    """States, times, and active and previous versions by the rules, one event after the other."""
    states, published, active = {}, {}, {}
    for c, v, action, at, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        now = states.get((c, v))
        others = [(published[k], k[1]) for k, s in states.items() if k[0] == c and s == "published" and k[1] != v]
        if action == "build" and now != "published":
            states[c, v] = "building"
        elif action == "ready" and now == "building":
            states[c, v] = "ready"
        elif action == "publish" and now == "ready":
            states[c, v], published[c, v], active[c] = "published", at, v
        elif action == "rollback" and active.get(c) == v and others:
            states[c, v], active[c] = "rolled_back", max(others)[1]
    previous = {c: max([(published[k], k[1]) for k, s in states.items() if k[0] == c and s == "published" and k[1] != v], default=(0, None))[1] for c, v in active.items()}
    return {(*k, s, published.get(k)) for k, s in states.items()}, {(c, v, previous[c]) for c, v in active.items()}


def found(spark, rows):
    states, active = lifecycle.version_history(spark.createDataFrame(rows, SCHEMA))
    return {tuple(r) for r in states.collect()}, {tuple(r) for r in active.collect()}


def test_refused_events_keep_the_state(spark):
    rows = [(1, 1, "build", 1, 1), (1, 1, "ready", 2, 2), (1, 1, "rollback", 3, 3), (1, 1, "publish", 4, 4)]
    assert found(spark, rows) == ({(1, 1, "published", 4)}, {(1, 1, None)})
    # The only published version isn't rolled back, and one that isn't active isn't either
    rows += [(1, 1, "rollback", 5, 5), (1, 2, "build", 6, 6), (1, 2, "publish", 7, 7), (1, 2, "ready", 8, 8), (1, 2, "publish", 9, 9), (1, 1, "rollback", 10, 10)]
    assert found(spark, rows) == ({(1, 1, "published", 4), (1, 2, "published", 9)}, {(1, 2, 1)})
    rows += [(1, 2, "rollback", 11, 11), (1, 2, "build", 12, 12), (1, 1, "build", 13, 13)]
    assert found(spark, rows) == ({(1, 1, "published", 4), (1, 2, "building", 9)}, {(1, 1, None)})
    assert found(spark, rows) == history(rows)


@pytest.mark.parametrize("size", [10**6, 50])
def test_histories(spark, monkeypatch, size):
    monkeypatch.setattr(machines, "RANGE_ROWS", size)
    rng = random.Random(size)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 4), rng.randint(0, 7), rng.choice(["build", "ready", "ready", "publish", "publish", "rollback", "unknown", None]), i // 3, i) for i in range(900)]
    assert found(spark, rows) == history(rows)


def test_no_events(spark):
    assert found(spark, []) == (set(), set())


def test_guard_refuses_and_stays(spark):
    rows = [(1, i, s) for i, s in enumerate(["queued", "done", "running", "queued", "done", None, "running"])]
    refused = ops.invalid_transitions(spark.createDataFrame(rows, "k int, n int, s string"), "k", ["n"], "s", [("queued", "running"), ("running", "done")]).collect()
    assert sorted((r["n"], r["from"], r["s"]) for r in refused) == [(1, "queued", "done"), (3, "running", "queued"), (5, "done", None), (6, "done", "running")]


def test_traces_count_up_to_their_end(spark):
    rows = [(1, 1, "open"), (1, 2, "completed"), (1, 3, "failed"), (1, 4, "x"), (2, 1, "x"), (2, 2, None), (None, 5, "abstained"), (None, 6, "x")]
    found = ops.trace_states(spark.createDataFrame(rows, "t int, n int, s string"), "t", ["n"], "s").collect()
    assert {tuple(r) for r in found} == {(1, "completed", 2), (2, "open", 2), (None, "abstained", 1)}
