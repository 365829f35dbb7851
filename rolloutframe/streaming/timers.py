"""Timers: waiting for enough with a time-out, alarms of silence, and the heartbeat of queries themselves.

Timers of event time fire when the watermark passes them, which rows of other keys bring about; those of processing time
(``live``) when the clock does, with no row at all. Rows of one micro-batch are taken in the order of their times, and a
timer that would have fired between two of them does so in its place.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

LIVE = "ProcessingTime"


class _Timed(StatefulProcessor):
    """One timer a key, moved by rows."""

    def __init__(self, live: bool):
        self.live = live

    def _times(self, rows: Iterator[pd.DataFrame], timer_values, column: str) -> list[tuple[int, int]]:
        """(milliseconds, value) of the rows in order; with processing time all come now."""
        now = timer_values.getCurrentProcessingTimeInMs()
        return sorted((now if self.live else int(t), int(n)) for pdf in rows for t, n in zip(pdf["at"], pdf[column], strict=True))

    def _arm(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Enough(_Timed):
    """A batch goes out at ``threshold`` tokens, or ``wait`` milliseconds after its first row."""

    def __init__(self, threshold: int, wait: int, live: bool):
        super().__init__(live)
        self.threshold, self.wait = threshold, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "batch long, rows long, tokens long, since long")

    def _told(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["run", "batch", "rows", "tokens", "reason", "at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, many, tokens, since = self.held.get() if self.held.exists() else (0, 0, 0, None)
        out = []
        for at, n in self._times(rows, timerValues, "tokens"):
            if since is not None and at > since + self.wait:
                out.append((batch, many, tokens, "timeout", since + self.wait))
                batch, many, tokens, since = batch + 1, 0, 0, None
            many, tokens, since = many + 1, tokens + n, at if since is None else since
            if tokens >= self.threshold:
                out.append((batch, many, tokens, "full", at))
                batch, many, tokens, since = batch + 1, 0, 0, None
        self.held.update((batch, many, tokens, since))
        self._arm(None if since is None else since + self.wait)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, many, tokens, since = self.held.get() if self.held.exists() else (0, 0, 0, None)
        at = expiredTimerInfo.getExpiryTimeInMs()
        if since is not None and since + self.wait <= at:
            self.held.update((batch + 1, 0, 0, None))
            yield from self._told(key, [(batch, many, tokens, "timeout", at)])


class Silence(_Timed):
    """An alarm when ``wait`` milliseconds go by behind a beat, once for each silence."""

    def __init__(self, wait: int, live: bool):
        super().__init__(live)
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, _ in self._times(rows, timerValues, "beat"):
            if last is not None and at > last + self.wait:
                out.append((key[0], last, last + self.wait))
            last = at if last is None else max(last, at)
        self.last.update((last,))
        self._arm(last + self.wait)
        if out:
            yield pd.DataFrame(out, columns=["run", "last", "alarm"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None and last + self.wait <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()  # a beat after an alarm begins anew
            yield pd.DataFrame([(key[0], last, last + self.wait)], columns=["run", "last", "alarm"])


def _timed(stream: DataFrame, column: str, delay: str, live: bool) -> DataFrame:
    rows = stream if live else stream.withWatermark("ts", delay)
    return rows.select("run", "ts", F.unix_millis("ts").alias("at"), column)


def enough_or_timeout(stream: DataFrame, threshold: int, wait: int, delay: str = "0 seconds", live: bool = False) -> DataFrame:
    """run, batch, rows, tokens, reason (full or timeout), at of the batches of a stream (run, ts, tokens). Without
    ``live``, rows that come more than ``delay`` behind the latest are dropped."""
    return _timed(stream, "tokens", delay, live).groupBy("run").transformWithStateInPandas(Enough(threshold, wait, live), "run long, batch long, rows long, tokens long, reason string, at long", "Append", LIVE if live else "EventTime")


def alarms(stream: DataFrame, wait: int, delay: str = "0 seconds", live: bool = False) -> DataFrame:
    """run, last, alarm (milliseconds) of the silences of a stream of beats (run, ts)."""
    return _timed(stream.withColumn("beat", F.lit(1)), "beat", delay, live).groupBy("run").transformWithStateInPandas(Silence(wait, live), "run long, last long, alarm long", "Append", LIVE if live else "EventTime")


class Heartbeat(StreamingQueryListener):
    """When each streaming query last got on; ``overdue`` names those that have not for a while."""

    def __init__(self, clock=time.monotonic):
        self.clock, self.beats, self.names = clock, {}, {}

    def _beat(self, query, name: str | None = None) -> None:
        self.beats[str(query)] = self.clock()
        if name:
            self.names[str(query)] = name

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._beat(event.id, event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._beat(event.progress.id, event.progress.name)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._beat(event.id)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.beats.pop(str(event.id), None)

    def overdue(self, seconds: float = 1800) -> list[str]:
        now = self.clock()
        return sorted(self.names.get(q, q) for q, at in self.beats.items() if now - at > seconds)
