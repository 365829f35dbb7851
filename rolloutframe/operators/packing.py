"""Packing samples into micro-batches and laying them out over workers.

Order decides first-fit packing, so one (run, step) is one group; its rows are ids and lengths only, and arrays join
afterwards. Everything else is expressions and windows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordering import numbered, running_sum

PACK_BLOCK = 2048  # samples of a block of concatenation packing


def prepare(sample: DataFrame, seq_len: int) -> DataFrame:
    """Prompt and completion as one sequence, cut to seq_len: ids, mask, per-token advantage, logprobs, temperatures, positions."""
    n = F.size("prompt_ids")
    first = F.coalesce(F.get("completion_temperatures", F.lit(0)), F.lit(1.0))
    whole = {
        "input_ids": F.concat("prompt_ids", "completion_ids"),
        "loss_mask": F.concat(F.array_repeat(F.lit(False), n), "completion_mask"),
        "inference_logprobs": F.concat(F.array_repeat(F.lit(0.0), n), "completion_logprobs"),
        "temperatures": F.concat(F.array_repeat(first, n), "completion_temperatures"),
    }
    out = sample.select("*", *[F.slice(c, 1, seq_len).alias(k) for k, c in whole.items()])
    return out.withColumn("advantages", F.transform("input_ids", lambda x: F.col("advantage"))).withColumn("position_ids", F.transform("input_ids", lambda x, i: i))


def validate(n_prompt: Column, n_mask: Column, n_completion: Column, n_completion_mask: Column, n_logprobs: Column, n_temperatures: Column, n_teacher: Column, seq_len: int) -> Column:
    """The first reason for which a sample is bad, in order; null for a good one."""
    return (
        F.when(n_prompt != n_mask, "prompt_mask").when(n_completion != n_completion_mask, "completion_mask").when(n_completion != n_logprobs, "logprobs")
        .when(n_completion != n_temperatures, "temperatures").when(n_completion == 0, "empty").when(n_prompt + n_completion > seq_len, "too_long")
        .when(n_teacher.isNotNull() & (n_teacher != n_prompt + n_completion), "teacher")
    )


def before_first_bad(samples: DataFrame, bad: Column, key: str = "run_id", order: str = "idx") -> DataFrame:
    """The samples of each run that come before its first bad one."""
    first = F.min(F.when(bad, F.col(order))).over(Window.partitionBy(key))
    return samples.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


def first_fit(lengths: list[int], seq_len: int, alone: list[bool] | None = None) -> list[int]:
    """The bin of each length, in the given order; ``alone`` ones get a bin of their own, as do lengths above seq_len.

    A tree of the largest room below each node finds the first bin with room in a logarithm of the bins.
    """
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room, out, opened = [seq_len] * (2 * leaves), [], 0
    for i, n in enumerate(lengths):
        own = bool(alone and alone[i]) or n > seq_len
        at = 1
        while at < leaves and not own:
            at = 2 * at if room[2 * at] >= n else 2 * at + 1
        at = leaves + opened if own else at
        opened = max(opened, at - leaves + 1)
        room[at] = -1 if own else room[at] - n
        out.append(at - leaves)
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return out


def _starts(t: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """The rows whose values in ``columns`` are not those of the row before; the first one too."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by key, as tables that end where a key does."""
    held: list[pa.RecordBatch] = []
    last: list[dict] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and b.slice(0, 1).select(list(keys)).to_pylist() != last:
            yield pa.Table.from_batches(held)
            held = []
        at = int(_starts(pa.Table.from_batches([b]), keys)[-1])
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = []
        held.append(b.slice(at))
        last = b.slice(b.num_rows - 1).select(list(keys)).to_pylist()
    if held:
        yield pa.Table.from_batches(held)


def _placed(samples: DataFrame, seq_len: int, workers: int, keys: tuple[str, ...], length: str) -> DataFrame:
    """keys, sample_id, bin, worker, slot, is_dummy, length: pack() and the places of a key's bins, in one pass.

    Spark sorts ids and lengths by key, and a task folds one key after another. A key's bins are numbered without gaps, so
    a bin's number is its place, and their count tells how many dummies follow.
    """
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, keys):
            lengths = [min(n, seq_len) for n in t[length].to_pylist()]
            opens = set(_starts(t, keys).tolist())
            bins: list[int] = []
            first, every = 0, []  # rows at which keys begin, and how many bins they have
            for i, j in pairwise([*_starts(t, (*keys, "lora_idx")).tolist(), t.num_rows]):
                if i in opens:
                    every.append(0)
                first = every[-1]
                own = first_fit(lengths[i:j], seq_len)
                bins += [first + b for b in own]
                every[-1] = first + max(own) + 1
            count = np.array(every)
            pads = -count % workers
            n = int(pads.sum())
            at = np.concatenate([np.arange(t.num_rows), np.repeat(sorted(opens), pads)])
            dummies = np.repeat(count + pads - np.cumsum(pads), pads) + np.arange(n)
            place = np.concatenate([np.array(bins), dummies]).astype(np.int64)
            dummy = np.arange(len(at)) >= t.num_rows
            real = pa.array(np.where(dummy, 0, at), pa.int64(), mask=dummy)
            columns = {k: t[k].take(pa.array(at)) for k in keys} | {"sample_id": t["sample_id"].take(real), "bin": pa.array(np.where(dummy, 0, place), pa.int32())}
            columns |= {"worker": pa.array(place % workers), "slot": pa.array(place // workers, pa.int32()), "is_dummy": pa.array(dummy), length: t[length].take(real)}
            yield from pa.table(columns).combine_chunks().to_batches()

    rows = samples.select(*keys, "lora_idx", "sample_id", length).repartition(*keys).sortWithinPartitions(*keys, "lora_idx", F.desc(length), "sample_id")
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, "sample_id")), "bin int, worker long, slot int, is_dummy boolean", f"`{length}` {kinds[length]}"]))


def pack(samples: DataFrame, seq_len: int, keys: tuple[str, ...] = ("run_id", "step"), length: str = "n_tokens") -> DataFrame:
    """keys, sample_id, bin: first-fit decreasing by (lora_idx, -length, arrival) under seq_len."""
    return _placed(samples, seq_len, 1, keys, length).select(*keys, "sample_id", "bin")


def pad_to_multiple(array: Column, multiple: int, value: Column) -> Column:
    return F.concat(array, F.array_repeat(value, F.pmod(-F.size(array), F.lit(multiple))))


def padded_to(array: Column, length: int, value: Column) -> Column:
    """An array of at most ``length`` values, padded to it."""
    return F.concat(array, F.array_repeat(value, length - F.size(array)))


def distribute(bins: DataFrame, workers: int, order: str = "bin", keys: tuple[str, ...] = (), kind: str | None = None) -> DataFrame:
    """worker and slot of every bin, with copies of a class's first bin as dummies (is_dummy) until each class divides by
    the number of workers; a slot holds one class over all workers.

    A bin's number in its class and the padded sizes of the classes in front of it give its place.
    """
    part = (*keys, *([kind] if kind else []))
    b = numbered(bins, [order], "_n", part).withColumn("is_dummy", F.lit(False))
    classes = bins.groupBy(*part).agg(F.count("*").alias("_all"))
    classes = classes.withColumn("_padded", F.col("_all") + F.pmod(-F.col("_all"), F.lit(workers)))
    front = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*([kind] if kind else [F.lit(0)])).rowsBetween(Window.unboundedPreceding, -1)  # a row for each class
    classes = classes.withColumn("_front", F.coalesce(F.sum("_padded").over(front), F.lit(0))).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(part)], "_all", "_padded", "_front")
    same = F.lit(True)
    for i, c in enumerate(part):
        same &= F.col(c).eqNullSafe(F.col(f"_c{i}"))
    b = b.join(classes, same).drop(*[f"_c{i}" for i in range(len(part))])
    dummies = b.where((F.col("_n") == 0) & (F.col("_padded") > F.col("_all"))).withColumn("_n", F.explode(F.sequence(F.col("_all"), F.col("_padded") - 1))).withColumn("is_dummy", F.lit(True))
    place = F.col("_front") + F.col("_n")
    return b.unionByName(dummies).withColumn("worker", F.pmod(place, F.lit(workers))).withColumn("slot", F.floor(place / workers).cast("int")).drop("_n", "_all", "_padded", "_front")


def carried(sizes: np.ndarray, seq_len: int) -> tuple[list[int], list[int], list[int], int | None]:
    """What a block of samples does to a pack that comes with c tokens, for every c from 0 to seq_len - 1: (c from which a
    piece holds, tokens that go on from the block, packs that end in it), and the block's tokens if a pack with few
    enough can pass without ending, for c below the first piece; it then goes on with c more.

    Only the place at which the first pack ends depends on c; from there on the ends are the same. Neighbouring pieces
    with the same results are one, and soon all are.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    first = np.searchsorted(total, total[:-1] + seq_len) - 1  # at which a pack that begins at each sample ends; n: not here
    rest, packs = (total[n] - total).tolist(), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = int(first[i]) + 1
        if j <= n:
            rest[i], packs[i] = rest[j], packs[j] + 1
    lows, outs, ends = [], [], []
    last = min(int(np.searchsorted(total, seq_len)), n)  # behind the sample at which a pack without tokens ends
    for i in range(last, 0, -1):
        low, high = max(0, seq_len - int(total[i])), seq_len - int(total[i - 1])
        if low < high and not (lows and outs[-1] == rest[i] and ends[-1] == packs[i] + 1):
            lows.append(low)
            outs.append(rest[i])
            ends.append(packs[i] + 1)
    return lows, outs, ends, int(total[n]) if total[n] < seq_len else None


def cat_pack(samples: DataFrame, seq_len: int, key: str, order: str = "idx", length: str = "n_tokens", block: int = PACK_BLOCK) -> DataFrame:
    """key, pack, n_samples, n_tokens of full packs: samples append until seq_len is reached; the excess and an unfinished
    tail are dropped.

    A key's samples are cut to blocks. Every block tells, by itself, what it does to each pack that may come into it
    (carried()); one row a block is then followed in order, and with what really comes the blocks cut their packs, again
    each by itself.
    """
    kind = samples.schema[key].dataType.simpleString()
    rows = numbered(samples.select(key, order, F.col(length).cast("long").alias("_n")), [order], "_place", (key,))
    place = F.struct("_place", "_n")
    blocks = rows.groupBy(key, F.floor(F.col("_place") / block).alias("_block")).agg(F.sort_array(F.collect_list(place))["_n"].alias("_sizes"))
    blocks = written(blocks)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [carried(x.values.to_numpy(), seq_len) for x in b.column(2)]
            columns = [pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array([g[3] for g in got], pa.int64())], names=[key, "_block", "lows", "outs", "ends", "through"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, pack = None, 0, 0
        for b in batches:
            came, number = [], []
            for k, lows, outs, ends, through in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if now is None or k != now[0]:
                    now, tokens, pack = (k,), 0, 0
                came.append(tokens)
                number.append(pack)
                i = bisect_right(lows, tokens) - 1
                tokens, pack = (outs[i], pack + ends[i]) if i >= 0 else (tokens + through, pack)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(came, pa.int64()), pa.array(number, pa.int64())], names=[key, "_block", "_came", "_pack"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, packs, counts, sums = [], [], [], []
            for row, (sizes, came, pack) in enumerate(zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                total = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
                i = 0
                while i < len(total) - 1:
                    j = min(int(np.searchsorted(total, total[i] + seq_len - came)), len(total) - 1)
                    at.append(row)
                    packs.append(pack)
                    counts.append(j - i)
                    sums.append(int(total[j] - total[i]))
                    i, pack, came = j, pack + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(packs, pa.int32()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=[key, "pack", "n", "t"])

    told = blocks.mapInArrow(maps, f"`{key}` {kind}, _block long, lows array<long>, outs array<long>, ends array<long>, through long")
    told = told.repartition(key).sortWithinPartitions(key, "_block").mapInArrow(follow, f"`{key}` {kind}, _block long, _came long, _pack long").withColumnRenamed(key, "_key")
    both = blocks.join(told.withColumnRenamed("_block", "_b"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b"))).select(key, "_sizes", "_came", "_pack")
    parts = both.mapInArrow(cut, f"`{key}` {kind}, pack int, n long, t long")
    return parts.groupBy(key, "pack").agg(F.sum("n").alias("n_samples"), F.sum("t").alias("n_tokens")).where(F.col("n_tokens") >= seq_len)


def bucket_of(length: Column, buckets: list[int]) -> Column:
    """The smallest bucket that holds a length; null beyond the largest."""
    out = F.lit(None).cast("int")
    for b in sorted(buckets, reverse=True):
        out = F.when(length <= b, F.lit(b)).otherwise(out)
    return out


def buckets_down(max_area: int, least: int = 256) -> list[int]:
    """max_area, max_area / 2, ... as long as they divide by ``least``."""
    out, b = [], max_area
    while b and b % least == 0:
        out.append(b)
        b //= 2
    return out


def shard(array: Column, rank: Column, ranks: int) -> Column:
    """A rank's contiguous part of a sequence whose length divides by the ranks."""
    size = F.floor(F.size(array) / ranks).cast("int")
    return F.slice(array, rank * size + 1, size)


def single_pack(samples: DataFrame, seq_len: int, workers: int, keys: tuple[str, ...] = ("run_id", "step"), length: str = "n_tokens") -> DataFrame:
    """keys, sample_id, bin, worker, slot, is_dummy, length of one run's steps; dummy bins have no sample and no length.

    Bins have the places that distribute() gives them, told by the task that packs them: ``samples`` are read once.
    """
    return _placed(samples, seq_len, workers, keys, length)


def _reached(queue: DataFrame, progress: DataFrame, budget: int, order: list[str], start: int, run: str, length: str) -> DataFrame:
    """The due samples of the runs that a selection comes to, with _turn (of their run, from ``start``), _fits, _ahead (the
    fitting tokens in front of a sample) and _end (the _ahead of the first oversize sample behind a fitting one).

    Runs are visited in turn and drained, so a selection is a prefix of the due samples by turn, step and order, without
    the oversize ones in front of all that fit. Sums of whole runs leave out the runs behind the budget. The queue is
    read twice, once for the sums and once for the rows; both are written, as later steps read them more than once.
    """
    runs = numbered(progress.select(run, F.col("step").alias("_due")), [run], "_place")
    count = runs.agg(F.count("*").alias("_runs"))
    runs = written(runs.join(F.broadcast(count)).withColumn("_turn", F.pmod(F.col("_place") - start, F.col("_runs"))).drop("_place", "_runs"))
    fits = F.col(length) <= budget
    tokens = F.when(F.col("_fits"), F.col(length)).otherwise(0).cast("long")

    def due(runs: DataFrame) -> DataFrame:
        return queue.join(runs, run).where(F.col("step") <= F.col("_due")).withColumn("_fits", fits)

    whole = written(due(runs).groupBy(run, "_due", "_turn").agg(F.sum(tokens).alias("_tokens")))
    whole = running_sum(whole, ["_turn"], F.col("_tokens"), "_first", inclusive=False)
    near = written(whole.where(F.col("_first") <= budget).select(run, "_due", "_turn"))
    rows = written(due(near).select(*queue.columns, "_turn", "_fits"))
    rows = running_sum(rows, ["_turn", "step", *order], tokens, "_ahead", inclusive=False)
    end = rows.where(~F.col("_fits") & (F.col("_ahead") > 0)).agg(F.min("_ahead").alias("_end"))
    return written(rows.join(F.broadcast(end)))


def fair_selection(queue: DataFrame, progress: DataFrame, budget: int, order: list[str], start: int = 0, run: str = "run", length: str = "n_tokens") -> tuple[DataFrame, int]:
    """(the samples that round robin takes under a token budget, with the queue's columns and their turn; next start).

    Runs stand in a ring by name, and ``start`` is the place of the first one. A run is drained of its due samples while
    its head fits; the first head that does not fit ends the selection. Oversize samples in front of all that fit are
    passed over. The next selection starts behind the last run that was visited.
    """
    progress = written(progress.select(run, "step"))
    rows = _reached(queue, progress, budget, order, start, run, length)
    open_ = F.col("_ahead") < F.coalesce(F.col("_end"), F.lit(budget + 1))
    taken = rows.where(F.col("_fits") & open_ & (F.col("_ahead") + F.col(length) <= budget))
    chosen = numbered(taken.select(*queue.columns, "_turn"), ["_turn", "step", *order], "turn").withColumn("turn", F.col("turn").cast("int"))
    stop = F.least(F.coalesce(F.col("_end"), F.lit(budget)), F.lit(budget))
    ends = F.min(F.when(~F.col("_fits") & (F.col("_ahead") > 0) & (F.col("_ahead") == F.col("_end")) & (F.col("_end") < budget), F.col("_turn")))
    last = rows.agg(F.coalesce(ends, F.max(F.when(F.col("_ahead") < stop, F.col("_turn")))).alias("at")).first()["at"]
    count = progress.count()
    return chosen.drop("_turn"), start % max(count, 1) if last is None else (start + last + 1) % count


def select_fair(queue: DataFrame, progress: DataFrame, budget: int, order: list[str], start: int = 0, run: str = "run", length: str = "n_tokens") -> DataFrame:
    """The samples of fair_selection()."""
    return fair_selection(queue, progress, budget, order, start, run, length)[0]


def advance_progress(queue: DataFrame, chosen: DataFrame, progress: DataFrame, order: list[str], run: str = "run", length: str = "n_tokens") -> DataFrame:
    """``progress`` (run, step, total_samples, total_tokens) after a selection: totals grow by what was taken, and a run's
    step goes on by one when nothing of it or of earlier steps is left in its queue."""
    taken = chosen.groupBy(run).agg(F.count("*").alias("_samples"), F.sum(length).alias("_tokens"))
    rest = queue.join(chosen, [run, "step", *order], "left_anti").groupBy(run).agg(F.min("step").alias("_next"))
    out = progress.join(taken, run, "left").join(rest, run, "left")
    done = F.col("_samples").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("step")))
    add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).cast("long").alias(c)
    return out.select(run, (F.col("step") + done.cast("int")).alias("step"), add("total_samples", "_samples"), add("total_tokens", "_tokens"), done.alias("ready"))


def multi_pack(queue: DataFrame, progress: DataFrame, seq_len: int, workers: int, order: list[str], start: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """(grid, progress, next start): a selection of seq_len * workers tokens over the runs from ``start`` on, each run
    packed and laid out by itself.

    ``queue``: run, step, sample_id, lora_idx, n_tokens and the columns of ``order``.
    """
    chosen, following = fair_selection(queue, progress, seq_len * workers, order, start)
    return single_pack(chosen, seq_len, workers, keys=("run",)), advance_progress(queue, chosen, progress, order), following


def enough_at(rows: DataFrame, order: list, length: str, threshold: int) -> DataFrame:
    """The rows up to and with the one at which ``threshold`` tokens are reached."""
    return running_sum(rows, order, F.col(length), "_before", inclusive=False).where(F.col("_before") < threshold).drop("_before")
