"""Shared parts of the vector searches: clean vectors, query blocks of bounded size, shards, and the merge of shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

QUERY_BLOCK = 16_384  # queries that are broadcast at a time: 8 MB at 64 dimensions


def clean(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id and v (array<double>) of the vectors without null or non-finite components; zero vectors only where asked for.

    Vectors of another length than most have (of equally many, the longest) take no part either.
    """
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        good &= F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def matrix(column) -> np.ndarray:
    """The rows of a list column as a float64 matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def shards(rows: DataFrame, count: int, least: int = 8192, most: int = 1 << 18) -> DataFrame:
    """The rows dealt evenly to shards of ``least`` to ``most`` vectors, about 64 shards in between.

    Repeated rows of one id are dealt to different shards.
    """
    size = min(max(count // 64, least), most)
    return rows.repartition(max(1, -(-count // size)), F.xxhash64("id", F.monotonically_increasing_id()))


def searched(spread: DataFrame, asked: DataFrame, make, score: str) -> DataFrame | None:
    """query_id, vec_id, score of every shard's best for every query; None without queries.

    ``make(ids, x)`` builds a shard's index, whose ``search(ids, q)`` returns (query numbers, vector ids, scores).
    Queries are broadcast in blocks of about QUERY_BLOCK, dealt by a hash of the id. Of several blocks each is searched
    and written before the next is collected, so that the driver and the executors hold one at a time.
    """
    spark = spread.sparkSession
    blocks = -(-asked.count() // QUERY_BLOCK)
    if blocks > 1:
        asked, spread = saved(asked), saved(spread)
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        sent = spark.sparkContext.broadcast((own.column("id").to_numpy(), matrix(own.column("v"))))

        def run(batches, sent=sent):
            got = [(x.column(0).to_numpy(), matrix(x.column(1))) for x in batches if x.num_rows]
            if not got:
                return
            index = make(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            del got
            ids, q = sent.value
            at, found, value = index.search(ids, q)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(value)], names=["query_id", "vec_id", "score"])

        part = spread.mapInArrow(run, f"query_id long, vec_id long, score {score}")
        if blocks > 1:
            part = saved(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def best(found: DataFrame, k: int, id_name: str, order: Column) -> DataFrame:
    """The first k of each query over all shards."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_name), "score")
