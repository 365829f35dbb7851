"""Streams drained to tables, and writers read back."""

import json
import uuid

from pyspark.sql import functions as F

from rolloutframe.sources import io
from rolloutframe.streaming import operators as O


def stream(spark, tmp_path, rows, schema):
    where = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(where)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)


def name():
    return f"t_{uuid.uuid4().hex}"


def test_groups_complete_across_batches(spark, tmp_path):
    rows = [(e, 1.0, e == 3 and i == 0) for e in (1, 2, 3) for i in range(2)] + [(1, 0.0, False)]
    s = stream(spark, tmp_path, rows, "example_id long, reward double, failed boolean")
    assert sorted(r.example_id for r in O.drain(O.complete_groups(s, 2), name()).collect()) == [1, 2]


def test_reorder_waits_and_drops_duplicates(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 0, "a"), (1, 1, "b"), (1, 3, "d"), (1, 1, "b"), (2, 1, "x")], "run_id long, step long, payload string")
    assert sorted((r.run_id, r.step) for r in O.drain(O.in_step_order(s), name()).collect()) == [(1, 0), (1, 1)]


def test_eval_fires_once(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, v) for v in (1, 4, 5, 6, 9, 10, 10)], "run_id long, version long")
    assert sorted(r.step for r in O.drain(O.eval_triggers(s, 5), name()).collect())[-1] == 10


def test_batches_round_trip(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 2).alias("run_id"), (F.col("id") % 5).alias("step"), F.col("id").alias("sample"))
    io.write_batches(df, str(tmp_path / "b"))
    assert io.read_batches(spark, str(tmp_path / "b")).count() == 20
    assert {r["sample"] for r in io.read_batches(spark, str(tmp_path / "b"), 1, 3).collect()} == {3, 13}


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "question string, reward double")
    io.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, io.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect())) == [("a", 1.5), ("b", None)]


def test_bad_benchmark_files_are_skipped(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text(json.dumps({"config": {"success": True, "type": "rl"}, "metrics": {"mfu": 0.5}}, indent=1))
    (tmp_path / "x" / "b.json").write_text("{not json")
    assert [r.metrics.mfu for r in io.read_benchmarks(spark, str(tmp_path)).where("config.success").collect()] == [0.5]


def test_sample_log_drops_and_falls_back(spark):
    rows = [("7", 0, ["p"], ["c"], ["t"]), ("x", 5, ["p"], ["c"], ["t"]), ("8", 1, ["p"], ["c"], None)]
    df = spark.createDataFrame(rows, "example_id string, sample_id long, prompt array<string>, completion array<string>, trajectory array<string>")
    for c, t in (("answer", "string"), ("task", "string"), ("info", "struct<a:int>"), ("reward", "double"), ("advantage", "double"), ("metrics", "map<string,double>"), ("timing", "struct<a:int>"), ("num_input_tokens", "long"), ("num_output_tokens", "long"), ("env_name", "string")):
        df = df.withColumn(c, F.lit(None).cast(t))
    out = io.sample_log(df, "r", 1, "train")
    assert len(out.columns) == 19
    assert sorted(r.problem_id for r in out.collect()) == [5, 7]


def test_latest_step(spark):
    steps = spark.createDataFrame([(1, True), (2, True), (3, False)], "step long, stable boolean")
    assert io.latest_step(steps) == 2
    assert [r.step for r in io.checkpoint_steps(steps, False).collect()] == [1, 2, 3]
