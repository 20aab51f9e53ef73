"""The rules of the keyed streams, without a stream, against plain versions; what a key keeps."""

from collections import deque

import numpy as np
import pandas as pd
import pytest

from harborlight.streaming import keyed


class Held:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, Held())

    def registerTimer(self, ms):
        self.timers.append(ms)


def driven(processor, events, batches, delay=180 * keyed.MINUTE):
    """Gives the events in batches of arrival with the watermark of the batches before; returns what came out and the largest state."""
    handle = Handle()
    processor.init(handle)
    out, now, largest = [], 0, 0
    for batch in [*batches, [], []]:
        rows = [events[i] for i in batch]
        for part in processor.run((1,), rows, now):
            out += part[["id", "kind", "value"]].itertuples(index=False, name=None)
        due = [t for t in handle.timers if t <= now]
        handle.timers = [t for t in handle.timers if t > now]
        if due:
            for part in processor.run((1,), [], now):
                out += part[["id", "kind", "value"]].itertuples(index=False, name=None)
        largest = max(largest, sum(len(s.rows) for s in handle.states.values()))
        now = max(now, max((r[1] for r in rows), default=0) - delay) if rows else 10**12
    return out, largest, handle


def events(seed, n):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(40_000, n, replace=False)) * keyed.MINUTE
    return [(i, int(t), bool(rng.random() < 0.4), bool(rng.random() < 0.8), int(rng.integers(0, 9))) for i, t in enumerate(at)]


def arrivals(rows, seed):
    """Batches in which rows come up to 170 minutes late."""
    rng = np.random.default_rng(seed)
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.integers(0, 170) * keyed.MINUTE)
    cuts = sorted(rng.choice(len(rows), 6))
    return [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


@pytest.mark.parametrize("seed", range(6))
def test_limit_equals_a_deque(seed):
    rows = events(seed, 300)
    out, _, handle = driven(keyed.Limit(4, 600, 3), rows, arrivals(rows, seed))
    calls, seen, expected = deque(), [], []
    for i, ms, _, _, what in rows:
        while calls and calls[0] < ms - 600 * keyed.MINUTE:
            calls.popleft()
        if not calls:
            seen = []
        allowed = len(calls) < 4
        expected.append((i, "allowed", allowed))
        if allowed:
            calls.append(ms)
            expected.append((i, "first", what not in seen))
            if what not in seen:
                seen = [*seen, what][-3:]
    assert sorted(out) == sorted(expected) and not any(s.rows for s in handle.states.values())  # nothing is left of a quiet client
    assert {x[2] for x in out if x[1] == "allowed"} == {True, False} == {x[2] for x in out if x[1] == "first"}


@pytest.mark.parametrize("seed", range(6))
def test_lags_and_labels_equal_a_search_and_state_is_bounded(seed):
    rows = events(seed, 2_000)
    out, largest, handle = driven(keyed.LagsAndLabels(120, 90, 30), rows, [[i] for i in range(2_000)])
    expected = []
    for k, (i, ms, _, ok, _) in enumerate(rows):
        before = rows[k - 1] if k else None
        expected.append((i, "lag", before[2] if before and ms - before[1] <= 120 * keyed.MINUTE else None))
        first = next((r for r in rows[k + 1 :] if r[1] >= ms + 60 * keyed.MINUTE), None)
        if ok and first and first[1] <= ms + 120 * keyed.MINUTE and first[3]:
            expected.append((i, "label", first[2]))
    assert sorted(out, key=str) == sorted(expected, key=str)
    assert largest < 60 and not any(s.rows for s in handle.states.values())  # of 2,000 rows
    late, _, _ = driven(keyed.LagsAndLabels(120, 90, 30), rows, arrivals(rows, seed))
    assert sorted(late, key=str) == sorted(expected, key=str)


class Counted(Held):
    calls = 0

    def get(self):
        self.calls += 1
        return super().get()


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("rules", [lambda: keyed.Limit(4, 600, 3), lambda: keyed.LagsAndLabels(120, 90, 30)])
def test_a_block_gives_what_its_stations_give_and_reads_its_state_once(rules):
    class Block(Handle):
        def getListState(self, name, schema):
            return self.states.setdefault(name, Counted())

    stations = {sid: events(sid, 200) for sid in range(50)}
    expected = sorted(((sid, *r) for sid, rows in stations.items() for r in driven(rules(), rows, [[i] for i in range(200)])[0]), key=str)
    block, handle, now, out = keyed.Blocks(rules()), Block(), 0, []
    block.init(handle)
    rows = pd.DataFrame([(sid, *r) for sid, part in stations.items() for r in part], columns=["sid", "id", "ms", "flag", "other", "what"]).sort_values("ms")
    for a in range(0, len(rows), 500):
        batch = rows[a : a + 500]
        for part in block.handleInputRows((0,), iter([batch[:200], batch[200:]]), Watermark(now)):
            out += part.itertuples(index=False, name=None)
        now = int(batch.ms.max()) - 180 * keyed.MINUTE
    assert all(s.calls == len(rows) / 500 and len(s.rows) <= 1 for s in handle.states.values()) and len(handle.timers) <= len(rows) / 500
    for part in block.handleExpiredTimer((0,), Watermark(10**12), None):
        out += part.itertuples(index=False, name=None)
    assert sorted(out, key=str) == expected and not any(s.rows for s in handle.states.values())
