"""Stacking micro-batches: adjacent groups, vertical and horizontal stacks, power-of-two buckets with time-outs.

Folds see ids and lengths of one key only; arrays are collected per group afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered
from .packing import bucket_of, buckets_down

TIMEOUT = 10  # emitted batches


class Grouper:
    """The groups of a sequence of micro-batches, one after another."""

    def __init__(self, size: int, budget: int | None = None, horizontal: bool = False):
        self.size, self.budget, self.horizontal = max(1, size), None if budget is None else max(1, budget), horizontal
        self.number, self.kind, self.count, self.longest, self.total = -1, None, 0, 0, 0

    def add(self, kind, length) -> int:
        n = max(1, int(length))
        area = self.total + n if self.horizontal and kind == "flex_compaction" else (self.count + 1) * max(self.longest, n)
        if kind is not None and kind == self.kind and self.count < self.size and (self.budget is None or area <= self.budget):
            self.count, self.longest, self.total = self.count + 1, max(self.longest, n), self.total + n
        else:
            self.number, self.kind, self.count, self.longest, self.total = self.number + 1, kind, 1, n, n
        return self.number


def group_numbers(kinds: list, lengths: list[int], size: int, budget: int | None = None, horizontal: bool = False) -> list[int]:
    """The group of each micro-batch: neighbours of one kind stay together up to ``size`` of them and, where there is a
    budget, as long as rows times the longest (or, for "flex_compaction" laid out horizontally, the sum) is within it. A
    batch without a kind is alone."""
    g = Grouper(size, budget, horizontal)
    return [g.add(k, n) for k, n in zip(kinds, lengths, strict=True)]


def adjacent_groups(rows: DataFrame, key: str, order: list[str], kind: str, length: str, size: int, budget: int | None = None, horizontal: bool = False) -> DataFrame:
    """key, order, group of micro-batches in their order. Lengths are the longest over the ranks, so that all agree.

    Spark sorts by key and order; a task goes through its rows once and holds the state of one group.
    """
    names = [key, *order]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, g = object(), None
        for b in batches:
            out = []
            for k, what, n in zip(b.column(0).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                if g is None or k != last:
                    last, g = k, Grouper(size, budget, horizontal)
                out.append(g.add(what, n))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.int32())], names=[*names, "group"])

    dealt = rows.select(*names, kind, length).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in names), "group int"]))


def batched(rows: DataFrame, order: list, size: int, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the number of the batch of ``size`` neighbours in order that each is in."""
    return numbered(rows, order, name, by).withColumn(name, F.floor(F.col(name) / size))


def _gathered(rows: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_x"))


def _field(name: str) -> Column:
    return F.transform("_x", lambda x: x[name])


def _padded(name: str, kind) -> Column:
    """The padded rows of an array; null where no row has it, an error where only some have."""
    mixed = F.raise_error(F.lit(f"only some rows of a group have {name}")).cast(f"array<{kind.simpleString()}>")
    there = lambda x: x[name].isNotNull()
    return F.when(F.forall("_x", there), _field(name)).when(F.exists("_x", there), mixed)


def vertical_stack(rows: DataFrame, group: list[str], order: str, arrays: dict[str, object], calls: str | None = None) -> DataFrame:
    """group, each of ``arrays`` as rows padded with its value to the longest, sequence_lengths, and the rows' calls.

    An array that only some rows of a group have is an error; one that none has is null. With ``calls`` every row must
    have some. Rows are padded one by one, behind the shuffle that brings a group together, so that Spark compiles it.
    """
    first = next(iter(arrays))
    sized = rows.withColumn("_n", F.size(first)).withColumn("_w", F.max("_n").over(Window.partitionBy(*group)))
    fill = {name: F.array_repeat(F.lit(pad).cast(rows.schema[name].dataType.elementType), F.col("_w") - F.size(name)) for name, pad in arrays.items()}
    sized = sized.withColumns({name: F.concat(name, pads) for name, pads in fill.items()})
    g = _gathered(sized, group, order, [*arrays, "_n", *([calls] if calls else [])])
    out = [_field("_n").alias("sequence_lengths")]
    out += [_padded(name, rows.schema[name].dataType).alias(name) for name in arrays]
    if calls:
        lack = F.exists("_x", lambda x: F.coalesce(F.size(x[calls]), F.lit(0)) <= 0)
        out.append(F.when(lack, F.raise_error(F.lit("a row of a stack has no calls")).cast(f"array<{rows.schema[calls].dataType.simpleString()}>")).otherwise(_field(calls)).alias(calls))
    return g.select(*group, *out)


def offsets(lengths: Column) -> Column:
    """The start of each length in their sequence."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(lengths, none, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]


def horizontal_pack(rows: DataFrame, group: list[str], order: str, arrays: list[str]) -> DataFrame:
    """group, ``arrays`` one after another without padding, sequence_lengths and sequence_offsets."""
    g = _gathered(rows, group, order, arrays).withColumn("sequence_lengths", F.transform("_x", lambda x: F.size(x[arrays[0]])))
    return g.select(*group, *[F.flatten(_field(n)).alias(n) for n in arrays], "sequence_lengths", offsets(F.col("sequence_lengths")).alias("sequence_offsets"))


def collate(rows: DataFrame, batch: list[str], order: str, columns: list[str]) -> DataFrame:
    """batch and its rows' arrays as matrices; rows of different lengths are an error."""
    g = _gathered(rows, batch, order, columns)
    sizes = lambda n: F.transform("_x", lambda x: F.size(x[n]))
    bad = lambda n: F.raise_error(F.lit(f"{n} is not rectangular")).cast(f"array<{rows.schema[n].dataType.simpleString()}>")
    return g.select(*batch, *[F.when(F.array_min(sizes(n)) == F.array_max(sizes(n)), _field(n)).otherwise(bad(n)).alias(n) for n in columns])


class Shelf:
    """Rows that wait in levels of growing width; a level of width w is full at area / w rows.

    A level is due at the first sample that comes to it after its deadline: ``timeout`` emitted batches beyond the one at
    which it began. Levels that are due rise over the neighbours above that they leave unfilled, and the rows of all of
    them go out as one batch of the highest one's width, filled up with dummies (None).
    """

    def __init__(self, widths: list[int], area: int, timeout: int):
        self.widths, self.room, self.timeout = widths, [-(-area // w) for w in widths], timeout
        self.rows: list[list] = [[] for _ in widths]
        self.deadline: dict[int, int] = {}
        self.emitted = 0

    def _risen(self, level: int) -> int:
        """The level at which one that is due goes out."""
        for above, waiting in enumerate(accumulate(map(len, self.rows[level:])), level):
            # the sum holds the neighbour; it stays below if that would fill it
            if above > level and waiting >= self.room[above]:
                return above - 1
        return len(self.rows) - 1

    def add(self, level: int, row) -> tuple[int, list, str] | None:
        """(width, rows, reason) of the batch that goes out with this row, if one does."""
        self.rows[level].append(row)
        due = self.emitted > self.deadline.get(level, self.emitted)
        if not due and len(self.rows[level]) < self.room[level]:
            self.deadline.setdefault(level, self.emitted + self.timeout)
            return None
        top = self._risen(level) if due else level
        out = [x for k in range(top, level - 1, -1) for x in self.rows[k]]
        for k in range(level, top + 1):
            self.rows[k] = []
            self.deadline.pop(k, None)
        self.emitted += 1
        return self.widths[top], out + [None] * (self.room[top] - len(out)), "timeout" if due else "full"


def stack_pack(samples: DataFrame, max_area: int, key: str, order: str, length: str, timeout: int = TIMEOUT) -> DataFrame:
    """key, batch, slot, width, order (null for a dummy row), tokens (kept of the sample), reason of the emitted batches.

    Buckets hold rows of max_area, max_area / 2 and so on; what remains in them at the end is not emitted. A key is one
    stream of samples, and whether a bucket is late depends on all batches before, so a stream is followed in order by one
    task; Spark sorts it, and the task holds the rows that wait in the buckets, fewer than 2 * max_area / 256, however
    long the stream.
    """
    types = {f.name: f.dataType.simpleString() for f in samples.schema}
    widths = sorted(buckets_down(max_area))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shelf = None, None
        for b in batches:
            out: list[tuple] = []
            for k, i, n, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or k != now[0]:
                    now, shelf = (k,), Shelf(widths, max_area, timeout)
                full = shelf.add(widths.index(width), (i, n))
                if full:
                    out += [(k, shelf.emitted - 1, slot, full[0], *(row or (None, 1)), full[2]) for slot, row in enumerate(full[1])]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), b.schema.field(1).type, pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "batch", "slot", "width", order, "tokens", "reason"])

    kept = F.least(F.col(length).cast("int"), F.lit(max_area))
    dealt = samples.select(key, order, kept.alias("_n"), bucket_of(kept, widths).alias("_width")).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, f"`{key}` {types[key]}, batch int, slot int, width int, `{order}` {types[order]}, tokens int, reason string")
