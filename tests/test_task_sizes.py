"""What one task sorts does not grow with the tables."""

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rolloutframe.operators import tokens as T
from rolloutframe.sources import carriers


def largest(df):
    """Rows of the largest task, of all."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts), sum(counts)


def test_rollouts_are_dealt_by_size(spark, small, monkeypatch):
    monkeypatch.setattr(carriers, "PART", 16 << 10)
    n = carriers.parts(spark, carriers.table(spark, small, "lineitem"))
    assert n > 4
    for name in ("D01_group_mean_advantage", "D02_length_shaped_advantage", "D03_raw_advantage", "L01_custom_advantage", "L08_normalized_advantage", "B05_online_difficulty_filter", "B15_staleness_filter", "C05_zip_rollout_advantage"):
        most, every = largest(entry.queries()[name](spark, small))
        assert most < every / 3, name


def test_rows_that_compress_well_are_dealt_by_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lineitem.parquet")
    spark.range(300_000).select((F.col("id") % 2).alias("l_orderkey")).coalesce(1).write.parquet(path)
    monkeypatch.setattr(carriers, "ROWS", 10_000)
    assert carriers.parts(spark, carriers.table(spark, str(tmp_path), "lineitem")) == 30


def test_raw_advantage_has_tasks_as_large_on_a_larger_table(spark, small, tmp_path, monkeypatch):
    for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        rows = pq.read_table(f"{small}/{t}.parquet")
        i, shift = rows.schema.get_field_index(key), pc.max(pq.read_table(f"{small}/orders.parquet")["o_orderkey"]).as_py() + 1
        copies = [rows.set_column(i, rows.schema.field(i), pc.add(rows[key], k * shift)) for k in range(6)]
        pq.write_table(pa.concat_tables(copies), f"{tmp_path}/{t}.parquet")
    monkeypatch.setattr(carriers, "ROWS", 1_000, raising=False)
    most, every = largest(entry.queries()["D03_raw_advantage"](spark, small))
    larger, all_six = largest(entry.queries()["D03_raw_advantage"](spark, str(tmp_path)))
    assert all_six == 6 * every and larger < 2 * most


@pytest.mark.parametrize("name", ["B15_staleness_filter", "D03_raw_advantage"])
def test_tasks_that_read_rollouts_are_bounded_by_rows(spark, small, tmp_path, monkeypatch, name):
    for t in ("lineitem", "orders"):
        pq.write_table(pq.read_table(f"{small}/{t}.parquet"), f"{tmp_path}/{t}.parquet", row_group_size=500)
    old = spark.conf.get(carriers.SPLIT)
    monkeypatch.setattr(carriers, "READ", 1_000)
    monkeypatch.setattr(carriers, "SMALL", 1 << 10)
    try:
        rows = entry.queries()[name](spark, str(tmp_path))
        most, every = largest(carriers.table(spark, str(tmp_path), "lineitem"))
        assert every > 5_000 and most <= 1_500
        assert sorted(rows.collect()) == sorted(entry.queries()[name](spark, small).collect())
        spark.conf.set(carriers.SPLIT, "1k")
        entry.queries()[name](spark, str(tmp_path))
        assert spark.conf.get(carriers.SPLIT) == "1k"
    finally:
        spark.conf.set(carriers.SPLIT, old)


def test_the_top_is_sorted_out_of_few(spark):
    nan, inf = float("nan"), float("inf")
    kl = F.when(F.col("pos") == 77, nan).when(F.col("pos") == 78, inf).when(F.col("pos") == 79, None).otherwise((F.col("pos") % 7).cast("double"))
    t = spark.range(40_000, numPartitions=2).select((F.col("id") % 3).alias("seq_id"), F.col("id").alias("pos"), (F.col("id") % 11 != 0).alias("mask"), (F.col("id") % 5).alias("rank")).withColumn("mismatch_kl", kl)
    t = t.where("pos % 11 <> 0 or pos in (77)").withColumn("mask", F.col("mask") | (F.col("pos") == 77))
    want = [(r.seq_id, r.pos) for r in T.top_mismatch(t, 6).collect()]
    assert [(r.seq_id, r.pos) for r in T.merged_top(t, 6, "rank").collect()] == want and want[0][1] == 77 and want[1][1] == 78
    assert T._leading(t, 6, "rank").count() <= 6 * 5 * 6
    assert T.merged_top(t.where("pos in (79, 80)"), 6, "rank").count() == 2


def test_the_top_is_sorted_out_of_few_in_small_batches(spark):
    kl = F.when(F.col("pos") == 77, None).otherwise((F.col("pos") * 7919 % 10_007).cast("double"))
    t = spark.range(40_000, numPartitions=2).select((F.col("id") % 3).alias("seq_id"), F.col("id").alias("pos"), F.lit(True).alias("mask"), (F.col("id") % 5).alias("rank")).withColumn("mismatch_kl", kl)
    batch, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("2000", "64", "0"):
            spark.conf.set(batch, rows)
            assert T._leading(t, 6, "rank").count() <= 6 * 5 * 6
            assert T.merged_top(t, 6, "rank").collect() == T.top_mismatch(t, 6).collect()
            assert T._leading(t.where("pos < 0"), 6, "rank").count() == 0
    finally:
        spark.conf.set(batch, old)
