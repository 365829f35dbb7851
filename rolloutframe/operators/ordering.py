"""Row numbers, running sums and sliding frames over whole tables, without a window that gathers a table in one task.

Rows are dealt to ranges of the order and written; counts or sums of the ranges give each range's offset, and windows
run within ranges. Orders must be total for a reproducible result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK = 1 << 16  # rows of a sliding frame's task


def _ranges(rows: DataFrame, order: list) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def _offsets(sums: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """The value's sum over the ranges before, for each range (and key of ``by``)."""
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_{c}") for c in by]
    return sums.select(F.col("_part").alias("_range"), *keys, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_before"))


def _joined(rows: DataFrame, offsets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    on = F.col("_part") == F.col("_range")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    # without keys there is one row for each range
    return rows.join(offsets if by else F.broadcast(offsets), on).drop("_range", *[f"_{c}" for c in by])


def numbered(rows: DataFrame, order: list, name: str = "place", by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their number from 0 in ``order``, over the table or over each key of ``by``."""
    r = _ranges(rows, [*by, *order])
    offsets = _offsets(r.groupBy("_part", *by).agg(F.count("*").alias("_n")), by, "_n")
    within = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    return _joined(r.withColumn("_within", within), offsets, by).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_within", "_before")


def running_sum(rows: DataFrame, order: list, value: Column, name: str, by: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row, itself included or not."""
    r = _ranges(rows.withColumn("_v", value), [*by, *order])
    offsets = _offsets(r.groupBy("_part", *by).agg(F.sum("_v").alias("_s")), by, "_s")
    upto = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = F.coalesce(F.sum("_v").over(upto), F.lit(0))
    return _joined(r.withColumn("_w", within), offsets, by).withColumn(name, F.col("_before") + F.col("_w")).drop("_part", "_v", "_w", "_before")


def framed(rows: DataFrame, order: list, preceding: int, block: int = BLOCK) -> tuple[DataFrame, Window]:
    """(rows, window): frames of the last ``preceding`` rows and the current one run over the window, which is cut into
    blocks of the order; the last rows of a block come again in front of the next one, with _own false."""
    if preceding >= block:
        raise ValueError("a frame must be shorter than a block")
    n = numbered(rows, order, "_place").withColumn("_at", F.pmod("_place", F.lit(block)))
    home = F.floor(F.col("_place") / block)
    both = F.when(F.col("_at") >= block - preceding, F.array(home, home + 1)).otherwise(F.array(home))
    out = n.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == home).drop("_at")
    return out, Window.partitionBy("_block").orderBy("_place").rowsBetween(-preceding, 0)
