"""State of streams is read and written by blocks, not row by row."""

import numpy as np
import pandas as pd

from rolloutframe.streaming import operators as O
from rolloutframe.streaming import scheduling


class State:
    """A value, list or map state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, f):
        self.calls += 1
        return f()

    def exists(self):
        return self._call(lambda: "value" in self.held)

    def get(self):
        return self._call(lambda: self.held.get("value", iter(())))

    def update(self, v):
        self._call(lambda: self.held.update(value=v))

    put = update

    def clear(self):
        self._call(lambda: self.held.pop("value", None))

    def iterator(self):
        return self._call(lambda: iter(list(self.held.items())))

    def containsKey(self, k):  # noqa: N802
        return self._call(lambda: k in self.held)

    def getValue(self, k):  # noqa: N802
        return self._call(lambda: self.held[k])

    def updateValue(self, k, v):  # noqa: N802
        self._call(lambda: self.held.update({k: v}))

    def removeKey(self, k):  # noqa: N802
        self._call(lambda: self.held.pop(k, None))


class Handle:
    def __init__(self):
        self.states = {}

    def _state(self, name, *_):
        return self.states.setdefault(name, State())

    getValueState = getListState = getMapState = _state  # noqa: N815

    @property
    def calls(self):
        return sum(s.calls for s in self.states.values())


def fed(processor, *batches):
    """(a frame of what comes out of each micro-batch of frames, calls of the state)"""
    handle, out = Handle(), []
    processor.init(handle)
    for frames in batches:
        got = list(processor.handleInputRows((7,), iter(frames), None))
        out.append(pd.concat(got) if got else pd.DataFrame())
    return out, handle.calls


def test_reorder_calls(monkeypatch):
    monkeypatch.setattr(O, "OUT", 1000)
    n = 20_000
    order = np.random.default_rng(1).permutation(np.repeat(np.arange(n), 2))
    frame = lambda s: pd.DataFrame({"run_id": 7, "step": s, "payload": [f"p{x}" for x in s]})
    late, rest = order[order < 10], order[order >= 10]
    (one, two, three), calls = fed(O.ReorderBuffer(), np.array_split(frame(rest), 9), [frame(late)], [frame(np.array([n + 1, 3, n, n]))])
    assert not len(one) and two["step"].tolist() == list(range(n)) and three["step"].tolist() == [n, n + 1]
    assert two["payload"].tolist() == [f"p{x}" for x in range(n)] and calls < 30


def test_in_flight_calls():
    n = 20_000
    frame = lambda kind, at: pd.DataFrame({"run": 7, "at": at, "kind": kind, "id": pd.array(at if kind == "request" else [None] * len(at), dtype="Int64")})
    (one, two), calls = fed(scheduling.InFlight(3, 4, True), [frame("request", np.arange(n))], [frame("finish", np.arange(n, 2 * n))])
    assert one["queued"].tolist()[-1] == n - 3 and [x for s in one["started"] for x in s] == [0, 1, 2]
    assert [x for s in two["started"] for x in s] == list(range(3, n)) and two["flying"].tolist()[-1] == 0
    assert two["batch"].dropna().tolist() == list(range(n // 4)) and calls < 200
