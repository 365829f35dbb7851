"""Extension points: objects by dotted path, filters, losses, advantages, monitors, senders and receivers, run hooks."""

from __future__ import annotations

import importlib
import tomllib
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import tokens
from .sources import io


def import_object(path: str) -> Any:
    """The object of a path ``package.module.name`` or ``package.module:name``."""
    module, _, name = path.replace(":", ".").rpartition(".")
    return getattr(importlib.import_module(module), name)


def attribute(value: Column, path: str) -> Column:
    """A nested field by its dotted path."""
    for name in path.split("."):
        value = value.getField(name)
    return value


def with_attribute(value: Column, path: str, new: Column) -> Column:
    """A struct with a nested field replaced."""
    return value.withField(path, new)


# filters: (detected, index of the first detection) of a rollout's token ids and logprobs


class RolloutFilter(Protocol):
    name: str
    enforce: bool

    def check(self, ids: Column, logprobs: Column) -> Column:
        """The index of the first detection, null where there is none."""


@dataclass(frozen=True)
class GibberishFilter:
    token_id_threshold: int
    vocab: int
    logprob_offset: float
    enforce: bool = False
    name: str = "gibberish"

    def check(self, ids: Column, logprobs: Column) -> Column:
        return tokens.gibberish_index(ids, logprobs, self.token_id_threshold, self.vocab, self.logprob_offset)


@dataclass(frozen=True)
class RepetitionFilter:
    window: int
    prob_threshold: float
    enforce: bool = False
    name: str = "repetition"

    def check(self, ids: Column, logprobs: Column) -> Column:
        return tokens.repetition_index(logprobs, self.window, self.prob_threshold)


FILTERS: dict[str, Callable[..., RolloutFilter]] = {
    "gibberish": lambda vocab, token_id_threshold, logprob_offset, enforce=False: GibberishFilter(token_id_threshold, vocab, logprob_offset, enforce),
    "repetition": lambda vocab, window, prob_threshold, enforce=False: RepetitionFilter(window, prob_threshold, enforce),
}


def make_filter(config: dict, vocab: int) -> RolloutFilter:
    """A filter of a configuration with its ``type`` (a registered name or a dotted path) and options."""
    options = {k: v for k, v in config.items() if k != "type"}
    kind = config["type"]
    if kind in FILTERS:
        return FILTERS[kind](vocab, **options)
    if "." in kind or ":" in kind:
        return import_object(kind)(**options)
    raise ValueError(f"unknown filter {kind}")


def run_filters(rollouts: DataFrame, filters: list[RolloutFilter], ids: str = "ids", logprobs: str = "lp") -> DataFrame:
    """``rollouts`` after the filters in order: the first detection wins."""
    return tokens.apply_filters(rollouts, [(f.name, f.check(F.col(ids), F.col(logprobs)).isNotNull(), f.enforce) for f in filters])


# losses: (loss, metrics) of token rows, for each sequence


def ppo_clip(clip_eps: float = 0.2) -> dict[str, Column]:
    """Clipped policy loss and the share of clipped tokens: aggregates over a sequence's token rows (columns trainer,
    inference, advantage, mask)."""
    ratio = F.exp(F.col("trainer") - F.col("inference"))
    clipped = F.least(F.greatest(ratio, F.lit(1 - clip_eps)), F.lit(1 + clip_eps))
    both = F.least(ratio * F.col("advantage"), clipped * F.col("advantage"))
    masked = F.when(F.col("mask"), both)
    return {"loss": -F.coalesce(F.sum(masked), F.lit(0.0)), "clip_frac": F.avg(F.when(F.col("mask"), (ratio != clipped).cast("double")))}


def custom_loss(rows: DataFrame, path: str, key: str = "seq_id", **options) -> DataFrame:
    """key and the aggregates that the loss at a dotted path returns."""
    return rows.groupBy(key).agg(*[c.alias(n) for n, c in import_object(path)(**options).items()])


def ppo_clip_arrays(trainer, inference, advantage, mask, clip_eps: float = 0.2) -> dict[str, float | None]:
    """ppo_clip() of one sequence, from arrays of its tokens in order."""
    ratio = np.exp(trainer - inference)
    clipped = np.clip(ratio, 1 - clip_eps, 1 + clip_eps)
    both = np.minimum(ratio * advantage, clipped * advantage)[mask]
    return {"loss": -float(both.sum()), "clip_frac": float((ratio != clipped)[mask].mean()) if mask.any() else None}


def custom_array_loss(rows: DataFrame, path: str, columns: list[str], metrics: list[str], key: str = "seq_id", order: str = "pos", **options) -> DataFrame:
    """key and ``metrics`` (doubles) that the loss at a dotted path returns for each sequence: a function of arrays, one
    for each of ``columns``, for losses that are no aggregates of columns. A task holds one sequence at a time; numbers
    that are null are NaN, and a truth value that is null is false."""
    kind = rows.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        arrays = {}
        for c in columns:
            column = table.column(c)
            arrays[c] = (column.fill_null(False) if pa.types.is_boolean(column.type) else column.cast(pa.float64())).to_numpy()
        got = import_object(path)(**arrays, **options)
        return pa.table([table.column(key).slice(0, 1), *(pa.array([got[m]], pa.float64()) for m in metrics)], names=[key, *metrics])

    return rows.select(key, order, *columns).groupBy(key).applyInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{m}` double" for m in metrics)]))


# monitors


class Monitor(ABC):
    """Where metrics, samples and summaries go."""

    @abstractmethod
    def log(self, metrics: dict[str, float], step: int) -> None: ...

    def log_samples(self, rollouts: DataFrame, step: int) -> None: ...

    def log_eval_samples(self, rollouts: DataFrame, env: str, step: int) -> None: ...

    def log_distributions(self, distributions: DataFrame, step: int) -> None: ...

    def log_final_samples(self) -> None: ...

    def save_final_summary(self, name: str = "final_summary") -> None: ...

    def close(self) -> None: ...


class TableMonitor(Monitor):
    """Metrics and samples as tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, metrics: dict[str, float], step: int) -> None:
        rows = [(k, step, float(v)) for k, v in sorted(metrics.items())]
        self.spark.createDataFrame(rows, "key string, step long, value double").write.mode("append").parquet(f"{self.path}/metrics")

    def log_samples(self, rollouts: DataFrame, step: int) -> None:
        io.sample_table(rollouts).withColumn("step", F.lit(step).cast("long")).write.mode("append").parquet(f"{self.path}/samples")

    def save_final_summary(self, name: str = "final_summary") -> None:
        io.final_summary(self.spark.read.parquet(f"{self.path}/metrics"), "key", "value", "step").write.mode("overwrite").json(f"{self.path}/{name}")


class MultiMonitor(Monitor):
    """Passes every call on to its monitors; one that fails does not keep the others from it, and its error is kept."""

    def __init__(self, monitors: list[Monitor]):
        self.monitors, self.errors = monitors, []

    def _all(self, name: str, *args) -> None:
        for m in self.monitors:
            try:
                getattr(m, name)(*args)
            except Exception as e:  # noqa: BLE001  a monitor must not stop the run
                self.errors.append((type(m).__name__, name, e))

    def log(self, metrics, step):
        self._all("log", metrics, step)

    def log_samples(self, rollouts, step):
        self._all("log_samples", rollouts, step)

    def log_eval_samples(self, rollouts, env, step):
        self._all("log_eval_samples", rollouts, env, step)

    def log_distributions(self, distributions, step):
        self._all("log_distributions", distributions, step)

    def log_final_samples(self):
        self._all("log_final_samples")

    def save_final_summary(self, name="final_summary"):
        self._all("save_final_summary", name)

    def close(self):
        self._all("close")


# senders and receivers


class Sender(ABC):
    @abstractmethod
    def send(self, rows: DataFrame) -> None: ...


class Receiver(ABC):
    @abstractmethod
    def receive(self) -> DataFrame: ...


class TableSender(Sender):
    """Batches (run_id, step) or micro-batches (step, worker) as a partitioned table."""

    def __init__(self, path: str, micro: bool = False):
        self.path, self.micro = path, micro

    def send(self, rows: DataFrame) -> None:
        (io.write_micro_batches if self.micro else io.write_batches)(rows, self.path)


class TableReceiver(Receiver):
    """The next expected batch of each run, each once. With a schema the folder may still be without batches."""

    def __init__(self, spark: SparkSession, path: str, start: dict | None = None, schema: StructType | None = None):
        self.spark, self.path, self.steps, self.schema = spark, path, dict(start or {}), schema

    def receive(self) -> DataFrame:
        rows = io.read_batches(self.spark, self.path, schema=self.schema)
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("run_id", "step")}
        expected = self.spark.createDataFrame(list(self.steps.items()), f"run_id {kinds['run_id']}, _next {kinds['step']}")
        there = rows.select("run_id", "step").distinct().join(F.broadcast(expected), "run_id", "left")
        # the batches that are due: one at most for each run that has sent something
        due = there.where(F.col("step") == F.coalesce("_next", F.lit(0))).select("run_id", "step").collect()
        self.steps |= {r.run_id: r.step + 1 for r in due}
        due = self.spark.createDataFrame(due, f"run_id {kinds['run_id']}, step {kinds['step']}")
        return rows.join(F.broadcast(due), ["run_id", "step"], "left_semi")


def make_transport(kind: str, spark: SparkSession, path: str, micro: bool = False, schema: StructType | None = None) -> tuple[Sender, Receiver]:
    """Sender and receiver of a kind: "filesystem", where ``path`` is a folder, or "socket", where it is the address of a
    mailbox (host:port)."""
    if kind == "socket":
        from .sources.mailbox import SocketReceiver, SocketSender

        return SocketSender(path, micro), SocketReceiver(spark, path, schema, micro)
    if kind != "filesystem":
        raise ValueError(f"unknown transport {kind}")
    return TableSender(path, micro), TableReceiver(spark, path, schema=schema)


# run hooks and configuration

HOOKS = ("creation", "deletion", "forgotten", "discovered", "config_validation")


class RunHooks:
    """Callables by kind; validation hooks return (valid, message), and the first that fails decides."""

    def __init__(self):
        self.by_kind: dict[str, list[Callable]] = {k: [] for k in HOOKS}

    def register(self, kind: str, hook: Callable) -> None:
        self.by_kind[kind].append(hook)

    def fire(self, kind: str, *args) -> list:
        return [hook(*args) for hook in self.by_kind[kind]]

    def valid(self, config) -> tuple[bool, str]:
        for hook in self.by_kind["config_validation"]:
            good, message = hook(config)
            if not good:
                return False, message
        return True, ""

    def on_change(self, deleted: DataFrame, new: DataFrame, key: str = "run") -> None:
        """Fires for the runs that a discovery found new or gone (a row for each run folder)."""
        for row in deleted.select(key).collect():
            self.fire("deletion", row[0])
        for row in new.select(key).collect():
            self.fire("creation", row[0])


def read_config(text: str, into: type, hooks: RunHooks | None = None):
    """(config, "") of a TOML text as a dataclass, or (None, message) where it cannot be read or a hook refuses it."""
    try:
        got = tomllib.loads(text)
        unknown = set(got) - {f.name for f in fields(into)}
        if unknown:
            return None, f"unknown keys {sorted(unknown)}"
        config = into(**got)
    except (tomllib.TOMLDecodeError, TypeError, ValueError) as e:
        return None, f"Error parsing config: {e}"
    good, message = hooks.valid(config) if hooks else (True, "")
    return (config, "") if good else (None, message)
