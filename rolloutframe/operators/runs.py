"""Runs, their batches, checkpoints and in-flight requests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discovered(runs: DataFrame, evicted: DataFrame, key: str = "run") -> DataFrame:
    """The runs without an eviction mark."""
    return runs.join(evicted.select(key).distinct(), key, "left_anti")


def changed(known: DataFrame, present: DataFrame, key: str = "run") -> tuple[DataFrame, DataFrame]:
    """(deleted, new) runs: the anti joins both ways."""
    return known.join(present, key, "left_anti"), present.join(known, key, "left_anti")


def next_batches(batches: DataFrame, progress: DataFrame, key: str = "run") -> DataFrame:
    """Of each run the batch of its next expected step; runs that are ready to update give none."""
    due = progress.where(~F.col("ready")).select(key, "step")
    return batches.join(due, [key, "step"], "left_semi")


def accepted(batches: DataFrame, progress: DataFrame, key: str = "run") -> DataFrame:
    """key, step of the batches that an exactly-once reader takes: each step once, from the run's expected step on, up to
    the first gap."""
    steps = batches.select(key, "step").distinct().join(progress.select(key, F.col("step").alias("_from")), key).where(F.col("step") >= F.col("_from"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("step")) - 1
    return steps.withColumn("_n", n).where(F.col("step") == F.col("_from") + F.col("_n")).select(key, "step")


def oldest_pending(batches: DataFrame, value: str, key: str = "run") -> DataFrame:
    """The oldest waiting step of each run and its value."""
    return batches.groupBy(key).agg(F.min("step").alias("step"), F.min_by(value, "step").alias(value))


def retained(steps: DataFrame, last: int, every: int, key: str = "run", order: str = "step") -> DataFrame:
    """The ``last`` newest steps of each run and all multiples of ``every``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return steps.withColumn("_n", n).where((F.col("_n") <= last) | (F.col(order) % every == 0)).drop("_n")


def weight_dir(checkpoint: Column, checkpoint_stable: Column, broadcast: Column, broadcast_stable: Column, check: bool = True) -> Column:
    """The checkpoint's path where stable, else the broadcast's; where neither is, an error or the broadcast's path."""
    found = F.when(checkpoint_stable, checkpoint).when(broadcast_stable, broadcast)
    return F.coalesce(found, F.raise_error(F.lit("no weights of this step")).cast("string") if check else broadcast)


def resume_step(stable: DataFrame, wanted: int = -1) -> int | None:
    """The wanted step if it is stable, the latest stable one for -1, else none."""
    s = stable if wanted < 0 else stable.where(F.col("step") == wanted)
    return s.agg(F.max("step")).first()[0]


def stale_broadcast(step: Column, checkpoint: Column, broadcast: Column) -> Column:
    """Whether a start at a checkpoint would meet newer broadcast weights that are left from before."""
    return (step == checkpoint) & F.coalesce(broadcast > checkpoint, F.lit(False))


def may_run(step: Column, version: Column, max_async: int) -> Column:
    """Whether a consumer of a version may work on a step: it is at most ``max_async`` versions ahead."""
    return step - version <= max_async


def requeued(inflight: DataFrame, group: str = "group") -> DataFrame:
    """Rollouts that each group must schedule again when weights change: those of its unfinished requests."""
    return inflight.where(~F.col("done")).groupBy(group).agg(F.sum("rollouts").cast("long").alias("rollouts_to_schedule"))


def may_schedule(cost: Column, inflight: Column, most: int, draining: Column) -> Column:
    """Whether a request of a cost may start: not while draining, and within the capacity that is left."""
    return ~draining & (cost <= most - inflight)


def lifecycle(log: DataFrame, key: str = "run", order: str = "at") -> DataFrame:
    """key, state, since of each run from a log of (key, order, kind): the last of create, delete and evict counts; an
    evicted run stays evicted until it is created again."""
    last = log.groupBy(key).agg(F.max_by("kind", order).alias("kind"), F.max(order).alias("since"))
    state = F.when(F.col("kind") == "create", "active").when(F.col("kind") == "evict", "evicted").otherwise("deleted")
    return last.select(key, state.alias("state"), "since")


def history(log: DataFrame, key: str = "run", order: str = "at") -> DataFrame:
    """key, state, valid_from, valid_to (null: still valid) of each run from a log of (key, order, kind) whose order tells
    events apart. Of a run that does not exist an eviction or a deletion changes nothing; an evicted one stays evicted
    until it is created again or deleted; neighbouring rows of one state are one."""
    by = Window.partitionBy(key).orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # a run exists if the last event in front that is no eviction made it
    there = F.coalesce(F.last(F.when(F.col("kind") != "evict", F.col("kind") == "create"), ignorenulls=True).over(before), F.lit(False))
    state = F.when(F.col("kind") == "create", "active").when(F.col("kind") == "evict", "evicted").otherwise("deleted")
    rows = log.select(key, order, "kind", there.alias("_there")).where(F.col("_there") | (F.col("kind") == "create")).withColumn("state", state)
    rows = rows.withColumn("_last", F.lag("state").over(by)).where(F.col("_last").isNull() | (F.col("_last") != F.col("state")))
    return rows.select(key, "state", F.col(order).alias("valid_from"), F.lead(order).over(by).alias("valid_to"))


def upserted(versions: DataFrame, changes: DataFrame, key: str = "run") -> DataFrame:
    """A history() after a further log, whose events are later than all that it was made from: only keys with changes are
    worked on. Columns of both: as history(); ``changes`` is a log with the order ``at``."""
    touched = changes.select(key).distinct()
    kept = versions.join(touched, key, "left_anti")
    as_log = versions.join(touched, key, "left_semi").select(key, F.col("valid_from").alias("at"), F.when(F.col("state") == "active", "create").when(F.col("state") == "evicted", "evict").otherwise("delete").alias("kind"))
    return kept.unionByName(history(as_log.unionByName(changes.select(key, "at", "kind")), key))


def state_at(probes: DataFrame, versions: DataFrame, key: str = "run", at: str = "at") -> DataFrame:
    """``probes`` with the state of their run at their time, from history(); null before its first. Both sides are laid
    behind each other by key and time, and the last version in front counts: an as-of join in one sort."""
    time, own = F.col(at), [F.col(c) for c in probes.columns]
    v = versions.select(F.col(key).alias("_k"), F.col("valid_from").alias("_t"), F.col("state").alias("_s"), F.lit(0).alias("_probe"), F.lit(None).cast(probes.select(F.struct(*own)).schema[0].dataType).alias("_row"))
    p = probes.select(F.col(key).alias("_k"), time.alias("_t"), F.lit(None).cast("string").alias("_s"), F.lit(1).alias("_probe"), F.struct(*own).alias("_row"))
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    return v.unionByName(p).withColumn("state", last).where("_probe = 1").select("_row.*", "state")


def silences(beats: DataFrame, key: str, time: str, minutes: int = 30) -> DataFrame:
    """key, from, to of the gaps between beats that are longer than ``minutes``."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    return beats.withColumn("_before", before).where(F.col(time) > F.col("_before") + F.expr(f"interval {int(minutes)} minutes")).select(key, F.col("_before").alias("from"), F.col(time).alias("to"))


def after_state(rows: DataFrame, index: str, step: int, n: int) -> DataFrame:
    """The rows of the current epoch that an iterator at ``step`` (rows given so far) over ``n`` rows has still to give."""
    epoch, given = divmod(step, max(n, 1))
    return rows.where(F.col(index) >= given).withColumn("epoch", F.lit(epoch).cast("long"))


def gauges(stats: DataFrame, known: DataFrame, key: str = "run") -> DataFrame:
    """stats of the current runs, and a row with removed = true for every known run that vanished."""
    gone = known.select(key).join(stats, key, "left_anti").withColumn("removed", F.lit(True))
    return stats.withColumn("removed", F.lit(False)).unionByName(gone, allowMissingColumns=True)


def ready_servers(servers: DataFrame, checks: DataFrame, port: int, position: str = "position") -> DataFrame:
    """Sorted addresses of the servers whose check, joined by position, found the model; failed checks count for nothing."""
    ok = servers.join(checks, position).where(F.coalesce(F.col("has_model"), F.lit(False)) & F.col("error").isNull())
    return ok.select(F.concat(F.lit("http://"), "ip", F.lit(f":{port}/v1")).alias("url")).distinct().orderBy("url")


def adapter_matches(path: Column, name: Column, loaded_path: Column, loaded_name: Column) -> Column:
    """Whether the loaded adapter is the desired one: true if none is desired, false if none is loaded; by path where
    there is one, else by name."""
    same = F.when(path.isNotNull(), path == loaded_path).otherwise(name == loaded_name)
    return F.when(path.isNull() & name.isNull(), F.lit(True)).when(loaded_path.isNull() & loaded_name.isNull(), F.lit(False)).otherwise(F.coalesce(same, F.lit(False)))


def full_batches(rows: DataFrame, order: list, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with batch, the number of the batch of ``size`` rows in order that a row is in; an unfinished last one waits."""
    from .ordering import numbered

    n = numbered(rows, order, "_place", by)
    last = n.groupBy(*by).agg(F.count("*").alias("_all"))
    n = n.join(F.broadcast(last), list(by)) if by else n.join(F.broadcast(last))
    batch = F.floor(F.col("_place") / size)
    return n.withColumn("batch", batch.cast("long")).where(F.col("batch") < F.floor(F.col("_all") / size)).drop("_place", "_all")


def stable_steps(steps: DataFrame, stable_only: bool = True) -> DataFrame:
    """Checkpoint steps, ascending. Columns in: step, stable."""
    return (steps.where("stable") if stable_only else steps).select("step").orderBy("step")


def steps_after(steps: DataFrame, resume: DataFrame) -> DataFrame:
    """The steps beyond the resume step (a table of one row), which a resume removes."""
    return steps.join(F.broadcast(resume.toDF("_resume"))).where("step > _resume").drop("_resume")


def due_samples(samples: DataFrame, progress: DataFrame, step: str, key: str = "run") -> DataFrame:
    """The samples of steps that their run has come to."""
    p = progress.select(key, F.col("step").alias("_due"))
    return samples.join(p, key).where(F.col(step) <= F.col("_due")).drop("_due")


def sample_totals(samples: DataFrame, tokens: Column, key: str = "run") -> DataFrame:
    """Samples and tokens of each run: a micro-batch holds one run's."""
    return samples.groupBy(key).agg(F.count("*").alias("samples"), F.sum(tokens).alias("tokens"))


def every(step: Column, interval: int) -> Column:
    """Whether a step is one that is logged."""
    return step % interval == 0
