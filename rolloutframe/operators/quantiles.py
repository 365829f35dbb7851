"""Exact order statistics of any number of groups, without gathering or sorting a group.

A wanted rank is closed in on: the range of values that holds it is cut to equal bins, rows are counted by bin, and the bin
with the rank, shrunk to the least and largest value that it holds, is the next range. Only counts are shuffled. A round
ends a rank whose bin holds one value; ranks whose bin holds few rows are then read off those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BINS = 4096
FEW = 4096  # rows of a range that one task may sort

INF = float("inf")


def _bin(v: Column, low: Column, high: Column) -> Column:
    """The number of a value's bin, never smaller for a larger value; infinities and NaN, the largest, have their own.

    A range of one value is one bin; in any other, the least and the largest value are in different ones. Halves are taken
    where a difference is beyond all doubles.
    """
    wide = high - low == INF
    width = F.when(wide, high / 2 - low / 2).otherwise(high - low)
    at = F.floor(F.when(wide, v / 2 - low / 2).otherwise(v - low) / F.nullif(width, F.lit(0.0)) * BINS)
    return F.when(F.isnan(v), BINS + 2).when(v == INF, BINS + 1).when(v == -INF, -1).otherwise(F.coalesce(at, F.lit(0))).cast("int")


def order_statistics(rows: DataFrame, value: str, keys: tuple[str, ...], ranks: dict[str, Column]) -> DataFrame:
    """keys, n (values that are not null), and for each name of ``ranks`` the value of that rank from 0, a whole number
    given by an expression of n. Null keys are a group; a group without values has n = 0 and nulls."""
    k = [f"_k{i}" for i in range(len(keys))]
    v = F.col("_v")
    data = rows.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)], F.col(f"`{value}`").cast("double").alias("_v"))
    finite = F.when(~F.isnan(v) & (F.abs(v) < INF), v)
    sizes = written(data.groupBy(*k).agg(F.count("_v").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")))
    # one row for each rank: ranges [low, high] with the number of smaller values
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    open_ = sizes.where("n > 0").select(*k, "n", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"), F.lit(0).cast("long").alias("before"), F.col("n").alias("many"), F.lit(True).alias("whole"), asked.alias("x"))
    open_ = written(open_.select(*k, "n", "low", "high", "before", "many", "whole", "x.*"))
    ends = []
    while True:
        todo = open_.where((F.col("many") > FEW) & (F.col("whole") | (F.col("low") < F.col("high"))))
        ends.append(open_.where(~((F.col("many") > FEW) & (F.col("whole") | (F.col("low") < F.col("high"))))))
        if todo.isEmpty():
            break
        ranges = todo.select(*k, "low", "high", "whole").distinct()
        inside = _met(data, ranges, k)
        bins = inside.groupBy(*k, "low", "high", "whole", _bin(v, F.col("low"), F.col("high")).alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = Window.partitionBy(*k, "low", "high", "whole").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS + 3 rows
        bins = bins.withColumn("left", F.coalesce(F.sum("c").over(upto), F.lit(0)))
        on = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*k, "low", "high", "whole")]
        at = F.col("t.rank") - F.col("t.before")
        next_ = todo.alias("t").join(bins.alias("b"), [*on, at >= F.col("b.left"), at < F.col("b.left") + F.col("b.c")])
        open_ = written(next_.select(*[F.col(f"t.{c}").alias(c) for c in (*k, "n")], F.col("b.least").alias("low"), F.col("b.most").alias("high"), (F.col("t.before") + F.col("b.left")).alias("before"), F.col("b.c").alias("many"), F.lit(False).alias("whole"), F.col("t.name").alias("name"), F.col("t.rank").alias("rank")))
    found = None
    for part in ends:
        found = part if found is None else found.unionByName(part)
    found = written(found)
    one = found.where(~F.col("whole") & (F.col("low") == F.col("high"))).select(*k, "name", F.col("low").alias("_value"))
    rest = found.where(F.col("whole") | (F.col("low") < F.col("high")))
    near = _met(data, rest.select(*k, "low", "high", "whole").distinct(), k)
    order = Window.partitionBy(*k, "low", "high", "whole").orderBy("_v")  # FEW rows at most
    near = near.withColumn("_place", F.row_number().over(order) - 1)
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*k, "low", "high", "whole")]
    few = rest.alias("t").join(near.alias("b"), [*on, F.col("t.rank") - F.col("t.before") == F.col("b._place")])
    few = few.select(*[F.col(f"t.{c}").alias(c) for c in (*k, "name")], F.col("b._v").alias("_value"))
    named = one.unionByName(few).groupBy(*k).agg(*[F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in ranks])
    same = F.lit(True)
    for c in k:
        same &= F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}"))
    out = sizes.alias("s").join(named.alias("f"), same, "left")
    return out.select(*[F.col(f"s.{a}").alias(c) for a, c in zip(k, keys, strict=True)], "s.n", *[F.col(f"f.{name}").alias(name) for name in ranks])


def _met(data: DataFrame, ranges: DataFrame, k: list[str]) -> DataFrame:
    """The values within each range of their group; all of a group where the range is its whole."""
    on = F.col("_v").isNotNull() & (F.col("r.whole") | ((F.col("_v") >= F.col("r.low")) & (F.col("_v") <= F.col("r.high"))))
    for c in k:
        on &= F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}"))
    return data.alias("d").join(ranges.alias("r"), on).select(*[F.col(f"d.{c}").alias(c) for c in k], "_v", "r.low", "r.high", "r.whole")


def lower(q: float) -> Column:
    """The rank below the quantile q of n values."""
    return F.floor(F.lit(q) * (F.col("n") - 1))


def upper(q: float) -> Column:
    return F.ceil(F.lit(q) * (F.col("n") - 1))


def between(q: float, low: Column, high: Column) -> Column:
    """The linear quantile from the values at lower(q) and upper(q)."""
    part = F.lit(q) * (F.col("n") - 1) - lower(q)
    return F.when(part == 0, low).otherwise(low + (high - low) * part)
