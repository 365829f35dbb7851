"""Spark helpers of the subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ONE_TASK = 500_000  # edges that one task may take: about 60 MB


BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, so that a Python worker holds a few MB of text at a time: one value for all."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set, as in local tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_WRITTEN: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table under the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete(df: DataFrame) -> None:
    """Remove a table that saved() wrote, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)


def saved_alone(make, spark: SparkSession) -> DataFrame:
    """The result of ``make()`` as a table, without the tables that were saved on the way to it."""
    before = len(_WRITTEN)
    out = saved(make())
    for path in _WRITTEN[before:-1]:
        _remove(spark, path)
    del _WRITTEN[before:-1]
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _forest(batches):
    """(node, root) of the edges of one task, by union-find over arrays."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    names, place = np.unique(np.concatenate([x for pair in got for x in pair] or [np.zeros(0, np.int64)]), return_inverse=True)
    up, at = list(range(len(names))), 0
    for a, _ in got:
        n = len(a)
        for x, y in zip(place[at : at + n].tolist(), place[at + n : at + 2 * n].tolist(), strict=True):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
        at += 2 * n
    root = np.array(up, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node of ``edges``; root is the smallest node of its component.

    Alternating large-star and small-star rounds: only minima per node are aggregated, so a hub needs no list of its
    neighbours. Each round is written to the shared folder; the loop ends when the edges stay the same. A graph that has
    at most ``one_task`` edges, from the start or after a round, is finished by union-find in one task.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, last, old = saved(e), None, None
    while True:
        if e.count() <= one_task:
            out = saved(e.coalesce(1).mapInArrow(_forest, "node long, root long"))
            for x in (e, old):
                if x is not None:
                    delete(x)
            return out
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        new = saved(small)
        mark = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if old is not None:
            delete(old)
        old, e = e, new
        if mark == last:
            delete(old)
            break
        last = mark
    leaf = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return leaf.unionByName(leaf.select(F.col("root").alias("node"), "root").distinct())
