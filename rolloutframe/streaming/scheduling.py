"""Requests in flight and their rate, as state of a stream.

in_flight() follows one stream of events of a run: requests that come, requests that finish, new versions of the weights,
and checkpoints, which show the state. It can begin with the state that a checkpoint has shown. rate_limited() gives every
request the time at which it may start.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "at long, kind string, id long"  # besides the key; kind: request, finish, version (its number is the id), checkpoint
TOLD = "run long, at long, kind string, started array<long>, flying int, queued int, version long, batch long, flying_ids array<long>, queued_ids array<long>"
STATE = "run long, queued_ids array<long>, flying_ids array<long>, pending long, version long, batch long, progress long"


BLOCK = 1024  # places of a queue in one entry of its state
OUT = 50_000  # rows of a frame that goes out


class Line:
    """The places of a queue as blocks of a map state: a call reads the blocks that it comes to, and writes at its end."""

    def __init__(self, state, head: int, tail: int):
        self.state, self.blocks, self.changed = state, {}, set()
        self.stored = range(head // BLOCK, (tail - 1) // BLOCK + 1) if head < tail else range(0)

    def _block(self, number: int) -> list:
        if number not in self.blocks:
            self.blocks[number] = list(self.state.getValue((number,))[0]) if number in self.stored else [None] * BLOCK
        return self.blocks[number]

    def get(self, place: int) -> int:
        return self._block(place // BLOCK)[place % BLOCK]

    def put(self, place: int, ident: int) -> None:
        self._block(place // BLOCK)[place % BLOCK] = ident
        self.changed.add(place // BLOCK)

    def write(self, head: int, tail: int) -> None:
        """What lies between ``head`` and ``tail`` is kept."""
        left = range(head // BLOCK, (tail - 1) // BLOCK + 1) if head < tail else range(0)
        for number in self.stored:
            if number not in left:
                self.state.removeKey((number,))
        for number in sorted(self.changed):
            if number in left:
                self.state.updateValue((number,), (self.blocks[number],))


class InFlight(StatefulProcessor):
    """At most ``limit`` requests are in flight; the others wait in the order in which they came.

    A finish without an id is that of the longest-flying request. After ``batch`` finished requests a batch is whole. A
    new version either drains (nothing starts until all in flight have finished, then the version counts) or restarts
    (all in flight go back to the front of the queue, and the version counts at once).
    """

    def __init__(self, limit: int, batch: int, restart: bool):
        self.limit, self.size, self.restart = limit, batch, restart

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getMapState("queue", "block long", "ids array<long>")
        self.flying = handle.getMapState("flying", "place long", "id long")
        self.now = handle.getValueState("now", "head long, tail long, started long, pending long, version long, batch long, progress long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        s = initialState.iloc[0]
        none = lambda x: None if pd.isna(x) else int(x)
        line = Line(self.queue, 0, 0)
        for i, x in enumerate(s["queued_ids"]):
            line.put(i, int(x))
        line.write(0, len(s["queued_ids"]))
        for i, x in enumerate(s["flying_ids"]):
            self.flying.updateValue((i,), (int(x),))
        self.now.update((0, len(s["queued_ids"]), len(s["flying_ids"]), none(s["pending"]), none(s["version"]), int(s["batch"]), int(s["progress"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, tail, started, pending, version, batch, progress = self.now.get() if self.now.exists() else (0, 0, 0, None, None, 0, 0)
        flying = {k[0]: v[0] for k, v in sorted(self.flying.iterator())}  # limit of them at most, the longest first
        line, stored = Line(self.queue, head, tail), dict(flying)
        events = pd.concat([pdf[["at", "kind", "id"]].astype({"id": "Int64"}) for pdf in rows], ignore_index=True).sort_values(["at", "kind", "id"], ignore_index=True)
        names = ["run", "at", "kind", "started", "flying", "queued", "version", "batch", "flying_ids", "queued_ids"]
        told = lambda out: pd.DataFrame(out, columns=names).astype({"version": "Int64", "batch": "Int64"})
        known = events["id"].notna().to_numpy()
        ids = events["id"].fillna(0).to_numpy("int64")
        out = []
        for n in range(len(events)):
            if n % OUT == 0:
                if out:
                    yield told(out)
                    out = []
                some = slice(n, n + OUT)
                part = zip(events["at"].to_numpy()[some].tolist(), events["kind"].to_numpy()[some].tolist(), ids[some].tolist(), known[some].tolist(), strict=True)
            at, kind, ident, there = next(part)
            ident = ident if there else None
            whole = synced = None
            if kind == "request":
                line.put(tail, ident)
                tail += 1
            elif kind == "finish":
                place = next((p for p, x in flying.items() if ident is None or x == ident), None)
                if place is not None:
                    del flying[place]
                    progress += 1
                    if progress == self.size:
                        whole, batch, progress = batch, batch + 1, 0
            elif kind == "version" and (version is None or ident > version):
                pending = ident if pending is None else max(pending, ident)
                if self.restart:
                    for x in reversed(flying.values()):
                        head -= 1
                        line.put(head, x)
                    flying = {}
            if pending is not None and not flying:
                synced = version = pending
                pending = None
            new = []
            while pending is None and len(flying) < self.limit and head < tail:
                x = line.get(head)
                flying[started] = x
                head, started = head + 1, started + 1
                new.append(x)
            shown = (list(flying.values()), [line.get(p) for p in range(head, tail)]) if kind == "checkpoint" else (None, None)
            out.append((key[0], at, kind, new, len(flying), tail - head, synced, whole, *shown))
        line.write(head, tail)
        for place in stored.keys() - flying.keys():
            self.flying.removeKey((place,))
        for place in flying.keys() - stored.keys():
            self.flying.updateValue((place,), (flying[place],))
        self.now.update((head, tail, started, pending, version, batch, progress))
        if out:
            yield told(out)

    def close(self) -> None:
        pass


def in_flight(events: DataFrame, limit: int, batch: int, restart: bool = False, state: DataFrame | None = None) -> DataFrame:
    """A row for each event of a stream (run, EVENT): what starts with it, how many are then in flight and queued, the
    version that counts from it on, the number of the batch that it makes whole, and at a checkpoint all ids.

    ``state``: a table (STATE) to begin with, a row for each run.
    """
    begin = None if state is None else state.groupBy("run")
    return events.select("run", "at", "kind", "id").groupBy("run").transformWithStateInPandas(InFlight(limit, batch, restart), TOLD, "Append", "None", begin)


class RateLimit(StatefulProcessor):
    """Starts of requests in the order of their times, ``limit`` in a period.

    As a bucket, each start fills it by one, and it leaks ``limit`` in a period: a full bucket's worth may start at once.
    Its fill is kept as the time at which it would be empty, times ``limit``, so that all is exact. With ``strict`` the last
    ``limit`` starts are kept, and no stretch of a period's length, wherever it begins, holds more of them.
    """

    def __init__(self, limit: int, period: int, strict: bool):
        self.limit, self.period, self.strict = limit, period, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.empty = handle.getValueState("empty", "at decimal(38,0)")
        self.last = handle.getMapState("last", "place long", "start long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        empty = int(self.empty.get()[0]) if self.empty.exists() else None
        out = []
        for at, ident in sorted((int(a), int(i)) for pdf in rows for a, i in zip(pdf["at"], pdf["id"], strict=True)):
            if self.strict:
                before = self.last.getValue((n % self.limit,)) if n >= self.limit else None
                start = at if before is None else max(at, before[0] + self.period)
                self.last.updateValue((n % self.limit,), (start,))
            else:
                # the bucket has room once it would be empty within limit - 1 starts' worth of leaking
                early = None if empty is None else empty - (self.limit - 1) * self.period
                start = at if early is None else max(at, -(-early // self.limit))
                empty = max(at * self.limit, empty if empty is not None else at * self.limit) + self.period
            n += 1
            out.append((key[0], ident, at, start))
        self.count.update((n,))
        if empty is not None:
            self.empty.update((Decimal(empty),))
        if out:
            yield pd.DataFrame(out, columns=["run", "id", "at", "start"])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int, period: int, strict: bool = False) -> DataFrame:
    """run, id, at, start of a stream of requests (run, id, at): the earliest start at ``limit`` a period. Times are whole
    numbers of one unit, and come in order."""
    return requests.select("run", "id", "at").groupBy("run").transformWithStateInPandas(RateLimit(limit, period, strict), "run long, id long, at long, start long", "Append", "None")


def starts(requests: DataFrame, limit: int, period: int, strict: bool = False, key: str = "run") -> DataFrame:
    """The same of a table (key, id, at), in closed form: a start is held back by an earlier request by as many periods'
    parts as requests stand between, so running maxima give it."""
    order = Window.partitionBy(key).orderBy("at", "id")
    n = requests.withColumn("_n", (F.row_number().over(order) - 1).cast("long"))
    if strict:  # each limit-th request waits for the one before it
        n = n.withColumn("_k", F.floor(F.col("_n") / limit)).withColumn("_lane", F.col("_n") % limit)
        lane = Window.partitionBy(key, "_lane").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
        start: Column = F.max(F.col("at") - F.col("_k") * period).over(lane) + F.col("_k") * period
    else:
        ahead = order.rowsBetween(Window.unboundedPreceding, -1)
        empty = F.max(F.col("at") * limit - F.col("_n") * period).over(ahead) + F.col("_n") * period
        start = F.greatest(F.col("at"), F.ceil((empty - (limit - 1) * period) / limit).cast("long"))
    return n.withColumn("start", start).drop("_n", "_k", "_lane")
