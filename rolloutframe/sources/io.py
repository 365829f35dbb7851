"""Readers and writers of rollouts, batches and benchmark records.

Batches and micro-batches are partitioned tables; the commit protocol of the writer takes the place of temporary names,
and partition pruning that of one file for each rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_dataset(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(kind).load(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_batches(samples: DataFrame, path: str) -> None:
    """Samples by run and step; earlier steps of the same path stay."""
    samples.write.mode("append").partitionBy("run_id", "step").parquet(path)


def read_batches(spark: SparkSession, path: str, run_id=None, step=None, schema: T.StructType | None = None) -> DataFrame:
    """All samples, or those of a run and a step by partition pruning. With a schema the folder may be without files."""
    df = read_dataset(spark, path, schema=schema)
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    return df if step is None else df.where(F.col("step") == step)


def write_micro_batches(grid: DataFrame, path: str) -> None:
    grid.write.mode("append").partitionBy("step", "worker").parquet(path)


def read_micro_batches(spark: SparkSession, path: str, worker: int, step: int, schema: T.StructType | None = None) -> DataFrame:
    return read_dataset(spark, path, schema=schema).where((F.col("step") == step) & (F.col("worker") == worker)).orderBy("slot")


def sample_log(rollouts: DataFrame, run_id: str, step: int, tag: str) -> DataFrame:
    """The 19 columns of the sample log. Rows without prompt, completion or trajectory are dropped; an example id that is
    no integer is replaced by the sample's number."""
    good = rollouts.where(F.col("prompt").isNotNull() & F.col("completion").isNotNull() & F.col("trajectory").isNotNull())
    text = lambda c: F.coalesce(F.to_json(c), F.lit(""))
    return good.select(
        F.lit(run_id).alias("run_id"), F.lit(step).cast("long").alias("step"), F.lit(tag).alias("tag"), F.coalesce(F.expr("try_cast(example_id as bigint)"), F.col("sample_id")).alias("problem_id"), F.col("sample_id").cast("long").alias("sample_id"),
        text("prompt").alias("prompt"), text("completion").alias("completion"), text("trajectory").alias("trajectory"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("task", F.lit("")).alias("task"), text("info").alias("info"),
        F.col("reward").cast("double").alias("reward"), F.col("advantage").cast("double").alias("advantage"), text("metrics").alias("metrics"), text("timing").alias("timing"),
        F.col("num_input_tokens").cast("long").alias("num_input_tokens"), F.col("num_output_tokens").cast("long").alias("num_output_tokens"), F.current_timestamp().alias("created_at"), F.col("env_name"),
    )


def write_sample_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("compression", "snappy").parquet(path)


BENCHMARK = "config struct<success: boolean, type: string, hardware: string, model: string, seq_len: long>, metrics struct<mfu: double, throughput: double, step_time: struct<mean: double, std: double, min: double, max: double>, peak_memory: struct<gib: double, pct: double>>"


def read_benchmarks(spark: SparkSession, path: str, schema: str = BENCHMARK, whole_files: bool = True) -> DataFrame:
    """Benchmark records of a tree of JSON files, one a file or one a line; what can't be parsed is skipped."""
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def checkpoint_steps(steps: DataFrame, stable_only: bool = True) -> DataFrame:
    """Checkpoint steps in ascending order. Columns: step, stable."""
    return (steps.where("stable") if stable_only else steps).select("step").orderBy("step")


def latest_step(steps: DataFrame) -> int | None:
    """The last stable step, or none."""
    return steps.where("stable").agg(F.max("step")).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Hadoop's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_subset(spark: SparkSession, root: str, subset: str | None, split: str, kind: str = "parquet") -> DataFrame:
    """The rows of one (subset, split) of a dataset laid out as root/subset/split, with __subset and __split."""
    path = "/".join(x for x in (root, subset, split) if x)
    return read_dataset(spark, path, kind).withColumn("__subset", F.lit(subset).cast("string")).withColumn("__split", F.lit(split))


def write_subsets(rows: DataFrame, root: str, subset: str, split: str = "train") -> None:
    """A dataset by subset and split, written in one pass: ``subset`` is a column."""
    rows.withColumn("__subset", F.col(subset)).withColumn("__split", F.lit(split)).write.partitionBy("__subset", "__split").parquet(root)


def read_subsets(spark: SparkSession, root: str, schema: T.StructType, subsets: list[str] | None = None, splits: list[str] | None = None) -> DataFrame:
    """The rows that write_subsets() wrote of the subsets and splits (all subsets, if none is named) in one scan, with
    __subset and __split; other folders are not read."""
    from ..operators.datasets import resolve_subsets

    every = T.StructType([*schema.fields, T.StructField("__subset", T.StringType()), T.StructField("__split", T.StringType())])
    rows = read_dataset(spark, root, schema=every)
    if subsets is None:
        return rows.where(F.col("__subset").isNotNull() & F.col("__split").isin(splits or ["train"]))
    own = F.lit(False)
    for name, split in resolve_subsets(subsets, splits):
        own |= (F.col("__subset") == name) & (F.col("__split") == split)
    return rows.where(own)


def load_dataset(spark: SparkSession, root: str, subsets: list[str] | None = None, splits: list[str] | None = None, kind: str = "parquet") -> DataFrame:
    """A dataset saved whole, where its folder holds dataset_info.json; else the union of its subsets and splits."""
    from ..operators.datasets import resolve_subsets

    if exists(spark, f"{root}/dataset_info.json"):
        return spark.read.option("pathGlobFilter", f"*.{kind}").format(kind).load(root)
    out = None
    for subset, split in resolve_subsets(subsets, splits):
        part = read_subset(spark, root, subset, split, kind)
        out = part if out is None else out.unionByName(part)
    return out


def save_pools(examples: DataFrame, rollouts: DataFrame, path: str) -> None:
    """Easy and hard examples (by column pool) and the rollout buffer as JSON lines."""
    for pool in ("easy", "hard"):
        write_jsonl(examples.where(F.col("pool") == pool), f"{path}/{pool}_examples")
    write_jsonl(rollouts, f"{path}/rollout_buffer")


def load_pools(spark: SparkSession, path: str, current: DataFrame, hash_keys: list[str], schema: str, rollout_schema: str) -> tuple[DataFrame, DataFrame]:
    """(env_name, example_id, pool of the current examples that a saved one matches; saved rollouts of known environments)."""
    from ..operators import pools

    saved = None
    for n, pool in enumerate(("easy", "hard")):  # the hard ones are moved last
        part = read_jsonl(spark, f"{path}/{pool}_examples", schema).withColumn("pool", F.lit(pool)).withColumn("saved_order", F.lit(n))
        saved = part if saved is None else saved.unionByName(part)
    return pools.restore(saved, current, hash_keys), known_envs(read_jsonl(spark, f"{path}/rollout_buffer", rollout_schema), current)


def known_envs(rollouts: DataFrame, examples: DataFrame) -> DataFrame:
    """The rollouts whose environment has examples."""
    return rollouts.join(examples.select("env_name").distinct(), "env_name", "left_semi")


def write_rollouts(rollouts: DataFrame, path: str, step: int) -> None:
    """Rollouts of a step as Parquet files with names of their own."""
    rollouts.write.mode("append").parquet(f"{path}/step_{step}")


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` with the sha256 of each as JSON."""
    return rows.withColumn("sha256", F.sha2(F.to_json(F.struct(*rows.columns)), 256))


def sample_table(rollouts: DataFrame) -> DataFrame:
    """rollout_id, input_ids (the last step's prompt and completion) and the events of every step as JSON; rollouts
    without a step are left out. Columns in: rollout_id, steps (structs with prompt_ids, completion_ids and, where there are any,
    compaction_events)."""
    last = F.element_at("steps", -1)
    names = rollouts.schema["steps"].dataType.elementType.fieldNames()
    events = F.transform("steps", lambda s: s["compaction_events"]) if "compaction_events" in names else F.transform("steps", lambda s: F.lit(None).cast("array<int>"))
    return rollouts.where(F.size("steps") > 0).select("rollout_id", F.concat(last["prompt_ids"], last["completion_ids"]).alias("input_ids"), F.to_json(events).alias("compaction_events"))


def eval_sample_table(rollouts: DataFrame, env: str, step: int, completion: str = "completion") -> DataFrame:
    """``rollouts`` with env and step, without those whose completion is empty."""
    return rollouts.where(F.length(completion) > 0).withColumn("env", F.lit(env)).withColumn("step", F.lit(step).cast("long"))


def final_summary(metrics: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each metric."""
    return metrics.groupBy(key).agg(F.max_by(value, order).alias(value))


def write_benchmarks(records: DataFrame, path: str) -> None:
    """Benchmark records (config, metrics) as JSON, one a line."""
    records.write.mode("overwrite").json(path)


def successful(records: DataFrame) -> DataFrame:
    """The benchmark records of runs that succeeded."""
    return records.where(F.col("config.success"))


def save_checkpoint(progress: DataFrame, buffer: DataFrame, path: str, step: int) -> None:
    """Progress and rollout buffer of a step; the mark of a stable step is written last."""
    progress.write.mode("overwrite").parquet(f"{path}/step_{step}/progress")
    buffer.write.mode("overwrite").parquet(f"{path}/step_{step}/buffer")
    write_text(progress.sparkSession, f"{path}/step_{step}/STABLE", "")


def load_checkpoint(spark: SparkSession, path: str, step: int) -> tuple[DataFrame, DataFrame]:
    if not exists(spark, f"{path}/step_{step}/STABLE"):
        raise FileNotFoundError(f"{path}/step_{step} is not stable")
    return spark.read.parquet(f"{path}/step_{step}/progress"), spark.read.parquet(f"{path}/step_{step}/buffer")
