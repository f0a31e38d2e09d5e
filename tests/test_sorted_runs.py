"""State of streams whose keys have more rows than memory: no run or part holds more than it may."""

import random

import pandas as pd
import pyarrow as pa

from tests.test_states import MS0, pages_brute
from webtel.streaming import lifecycle


class Map(dict):
    getValue, updateValue, iterator, exists = dict.get, dict.__setitem__, lambda self: iter(list(self.items())), lambda self: bool(self)

    def removeKey(self, key):
        del self[key]


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def small(monkeypatch):
    for name, n in (("RUN_ROWS", 50), ("PART_ROWS", 7), ("OUT_ROWS", 3)):
        monkeypatch.setattr(lifecycle, name, n)


def test_rows_come_back_in_order_and_part_by_part(monkeypatch):
    small(monkeypatch)
    rnd = random.Random(4)
    runs = lifecycle.SortedRuns(Handle(), pa.schema([("a", pa.int64()), ("b", pa.string())]))
    rows = [(rnd.randint(0, 60), rnd.choice(["x", "y", None])) for _ in range(700)]
    key = lambda r: (r[0], r[1] or "")
    first, rest = rows[:400], rows[400:]
    runs.add(pd.DataFrame(first[i : i + 20], columns=["a", "b"]) for i in range(0, 400, 20))
    assert len(runs.runs) > 5 and max(len(pa.ipc.open_stream(v[0]).read_all()) for v in runs.parts.values()) == 7
    before, taken = len(runs.parts), runs.take(30)
    head = [next(taken)]
    assert before - len(runs.parts) <= len(runs.runs)  # only the first part of each run has been read
    head += taken
    assert head == sorted((r for r in first if r[0] <= 30), key=key)
    runs.add(iter([pd.DataFrame(rest, columns=["a", "b"])]))
    assert min(runs.least()) == min(r[0] for r in rest)
    assert list(runs.take()) == sorted([r for r in first if r[0] > 30] + rest, key=key)
    assert not runs.runs and not runs.parts and not runs.least()


def test_pages_of_many_runs(monkeypatch):
    small(monkeypatch)
    rnd = random.Random(5)
    rows = [("t", MS0 + rnd.randrange(40_000) * 1_000, i, rnd.choice(["commit", "commit", "request", "active", "inactive", "gone"]), rnd.choice(["a", "b", None])) for i in range(900)]
    states, handle, out = lifecycle.PageStates(), Handle(), []
    states.init(handle)
    for part, mark in ((rows[:600], MS0 - 1), (rows[600:], MS0 + 10_000_000), ([], MS0 + 30_000_000)):
        if part:
            pdfs = (pd.DataFrame([r[1:] for r in part[i : i + 30]], columns=["at_ms", "order", "kind", "doc"]) for i in range(0, len(part), 30))
            assert not list(states.handleInputRows(("t",), pdfs, Now(MS0 - 1)))
        for due in sorted(t for t in handle.timers if t <= mark):
            handle.timers.remove(due)
            frames = list(states.handleExpiredTimer(("t",), Now(mark), None))
            assert all(len(f) <= lifecycle.OUT_ROWS + 2 for f in frames)
            out += [tuple(r) for f in frames for r in f.itertuples(index=False)]
    want = pages_brute(rows, MS0 + 30_000_000)
    assert sorted(out) == want and len(want) > 50
    assert all(at > MS0 + 30_000_000 for at in states.waiting.least())
