"""Structured Streaming forms of the stateful operators.

State is kept per key by transformWithStateInPandas or by stateful aggregation; where the rule is version order rather
than event time, the step number is the watermark's counterpart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import mailbox
from ..sources.io import exists
from ..sources.shared import new_path

CHUNK = 1024  # steps of an entry of a reorder buffer's state
OUT = 1 << 18  # rows after which a reorder buffer puts what has come in order


class GroupCompletion(StatefulProcessor):
    """Emits an example once all its ``n`` rollouts have arrived; failed ones do not count."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int, total double, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total, done = self.seen.get() if self.seen.exists() else (0, 0.0, False)
        for pdf in rows:
            good = pdf[~pdf["failed"]]
            n += len(good)
            total += float(good["reward"].sum())
        if n >= self.n and not done:
            done = True
            yield pd.DataFrame({"example_id": [key[0]], "n": [n], "mean_reward": [total / n]})
        self.seen.update((n, total, done))

    def close(self) -> None:
        pass


def complete_groups(stream: DataFrame, n: int) -> DataFrame:
    """example_id, n, mean_reward of examples as they complete. Columns in: example_id, reward, failed."""
    return stream.groupBy("example_id").transformWithStateInPandas(GroupCompletion(n), "example_id long, n int, mean_reward double", "Append", "None")


class ReorderBuffer(StatefulProcessor):
    """Emits a run's batches in step order, from its next expected step on; later ones wait, earlier ones are dropped.

    A micro-batch is followed in arrays: state is read once at its beginning, and what still waits at its end is written in
    chunks of CHUNK steps.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "step long")
        self.waiting = handle.getListState("waiting", "steps array<long>, payloads array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        step = self.next.get()[0] if self.next.exists() else 0
        steps, payloads = np.zeros(0, np.int64), pa.array([], pa.large_string())
        came: list[tuple[np.ndarray, pa.Array]] = [(np.array(s, np.int64), pa.array(p, pa.large_string())) for s, p in self.waiting.get()]

        def settled() -> Iterator[pd.DataFrame]:
            """What has come joins what waits, of equal steps the last; the steps that are due go out."""
            nonlocal step, steps, payloads
            every = np.concatenate([steps, *(s for s, _ in came)])
            order = np.argsort(every, kind="stable")
            line = every[order]
            order = order[(np.append(line[1:] != line[:-1], True) if len(line) else np.zeros(0, bool)) & (line >= step)]
            payloads, steps = pa.concat_arrays([payloads, *(p for _, p in came)]).take(pa.array(order)), every[order]
            came.clear()
            gaps = np.flatnonzero(steps != step + np.arange(len(steps)))
            due = int(gaps[0]) if len(gaps) else len(steps)
            for i in range(0, due, OUT):
                j = min(i + OUT, due)
                yield pd.DataFrame({"run_id": np.full(j - i, key[0]), "step": steps[i:j], "payload": payloads.slice(i, j - i).to_pandas()})
            step, steps, payloads = step + due, steps[due:], payloads.slice(due)

        new = sum(len(s) for s, _ in came)
        for pdf in rows:
            came.append((pdf["step"].to_numpy(np.int64), pa.array(pdf["payload"], pa.large_string(), from_pandas=True)))
            new += len(pdf)
            if new > max(OUT, len(steps)):
                yield from settled()
                new = 0
        yield from settled()
        self.next.update((step,))
        if len(steps):
            self.waiting.put([(steps[i : i + CHUNK].tolist(), payloads.slice(i, CHUNK).to_pylist()) for i in range(0, len(steps), CHUNK)])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def in_step_order(stream: DataFrame) -> DataFrame:
    """run_id, step, payload of a stream of batches, each run's steps in order and once."""
    return stream.groupBy("run_id").transformWithStateInPandas(ReorderBuffer(), "run_id long, step long, payload string", "Append", "None")


class EvalTrigger(StatefulProcessor):
    """Fires an evaluation at the highest multiple of the interval that a version passes, never twice."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version long, fired long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        version, fired = self.last.get() if self.last.exists() else (0, 0)
        out = []
        for v in sorted(int(x) for pdf in rows for x in pdf["version"]):
            top = v // self.interval * self.interval
            if top > version and top > fired:
                fired = top
                out.append(top)
            version = max(version, v)
        self.last.update((version, fired))
        if out:
            yield pd.DataFrame({"run_id": [key[0]] * len(out), "step": out})

    def close(self) -> None:
        pass


def eval_triggers(stream: DataFrame, interval: int) -> DataFrame:
    """run_id, step of the evaluations that a stream of (run_id, version) fires."""
    return stream.groupBy("run_id").transformWithStateInPandas(EvalTrigger(interval), "run_id long, step long", "Append", "None")


def staleness_filter(stream: DataFrame, current_version: int, max_off_policy: int) -> DataFrame:
    """Requests that are at most max_off_policy versions behind: the late-data rule, in versions."""
    return stream.where(F.lit(current_version) - F.col("version") <= max_off_policy)


def pools(stream: DataFrame) -> DataFrame:
    """Mean reward and pool of each example, as rollouts arrive (update or complete mode)."""
    mean = F.avg("reward")
    return stream.groupBy("env_name", "example_id").agg(F.count("*").alias("n"), mean.alias("avg_reward"), F.when(mean >= 1, "easy").when(mean <= 0, "hard").otherwise("normal").alias("pool"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, width: str, delay: str, value: str, *keys: str) -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are dropped. An extra over the original."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, gap: str, delay: str, *keys: str) -> DataFrame:
    """Counts in session windows. An extra over the original."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


class BatchEmitter(StatefulProcessor):
    """Emits a run's waiting rows as a batch once there are ``rows`` of them, or ``tokens`` tokens where that is given."""

    def __init__(self, rows: int | None, tokens: int | None):
        self.rows, self.tokens = rows, tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "idx long, n long")
        self.batch = handle.getValueState("batch", "batch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(int(i), int(n)) for i, n in self.waiting.get()]
        total = sum(n for _, n in held)
        batch = self.batch.get()[0] if self.batch.exists() else 0
        out = []
        for i, n in sorted((int(i), int(n)) for pdf in rows for i, n in zip(pdf["idx"], pdf["n"], strict=True)):
            held.append((i, n))
            total += n
            if len(held) >= self.rows if self.tokens is None else total >= self.tokens:
                out += [(batch, j) for j, _ in held]
                held, total, batch = [], 0, batch + 1
        self.waiting.put(held) if held else self.waiting.clear()
        self.batch.update((batch,))
        if out:
            yield pd.DataFrame({"run_id": [key[0]] * len(out), "batch": [b for b, _ in out], "idx": [j for _, j in out]})

    def close(self) -> None:
        pass


def continuous_batches(stream: DataFrame, rows: int | None = None, tokens: int | None = None) -> DataFrame:
    """run_id, batch, idx of a stream of (run_id, idx, n): batches of a row or a token target, in the order of idx."""
    return stream.groupBy("run_id").transformWithStateInPandas(BatchEmitter(rows, tokens), "run_id long, batch long, idx long", "Append", "None")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def started(stream: DataFrame, path: str, mode: str = "append", **trigger):
    """A streaming query that writes every micro-batch to a folder of its own number below ``path``, so that one that is
    run again replaces itself. A query takes its settings when it starts; the session's are then as before."""
    spark: SparkSession = stream.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def result(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a query of started() has written; in complete mode the last micro-batch."""
    spark: SparkSession = stream.sparkSession
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(stream.schema).parquet(f"{path}/rows/*")
    if mode == "complete":
        numbers = [int(f.rsplit("batch=", 1)[1].split("/", 1)[0]) for f in out.inputFiles()]
        out = spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={max(numbers)}")
    return out.select(*stream.columns)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what is available and returns its result as a table of the shared folder."""
    path = f"{new_path(stream.sparkSession)}/{name}"
    started(stream, path, mode).awaitTermination()
    return result(stream, path, mode)


def relay(stream: DataFrame, sender: str, rank: str | None = None, topics: tuple[str, ...] = (mailbox.BATCHES,), capacity: int = mailbox.CAPACITY) -> DataFrame:
    """The rows of a stream after they have gone through a mailbox on the driver's host: one query sends them, batch by
    batch, while one for each topic receives, so that the mailbox holds little at a time."""
    spark: SparkSession = stream.sparkSession
    path, host = new_path(spark), spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")
    with mailbox.Mailbox(host, capacity=capacity) as box:
        came = [mailbox.read_mailbox(spark, box.address, stream.schema, t) for t in topics]
        receiving = [started(c, f"{path}/{i}", processingTime="0 seconds") for i, c in enumerate(came)]
        try:
            mailbox.write_mailbox(stream, box.address, sender, f"{path}/sent", rank).awaitTermination()
            for q in receiving:
                q.processAllAvailable()
        finally:
            for q in receiving:
                q.stop()
    out = None
    for i, c in enumerate(came):
        part = result(c, f"{path}/{i}")
        out = part if out is None else out.unionByName(part)
    return out


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
