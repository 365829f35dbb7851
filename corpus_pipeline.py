"""Corpus pipeline: quality, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet under the shared folder and
reads it again as the next one's documents, and deletes what no later stage reads. All stages but the last return the
columns of ``documents``.

Edge cases: a null or empty text is scored like any; it is no near duplicate, takes no part in the mix and so ends there;
rows with a null id go through every stage, repeated rows of an id that stay are one document's copies; other columns
than those of ``documents`` are dropped; empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutframe.llm import pareto_mix, parity_join, pu_quality, sp_sampling, toxicity
from rolloutframe.llm._spark import delete, saved_alone
from rolloutframe.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY, TOXIC = 0.3, 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY."""
    model = pu_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return pu_quality.score(docs.select(*COLUMNS), model, score_col="_score").where(F.col("_score") >= QUALITY).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.score(docs.select(*COLUMNS), model, score_col="_score").where(F.col("_score") < TOXIC).select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    groups = parity_join.near_duplicates(docs, words=5, similarity=(80, 100))
    # repeated rows of the smallest id are one document; a row without an id stands for itself
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in as many copies as the mix takes of them."""
    mixed = pareto_mix.pareto_mix(docs, keep=("text", "lang", "source", "n_chars"))
    return mixed.where("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"), *COLUMNS).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the sampled piece ids of each document."""
    return sp_sampling.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", unique), ("mix", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = saved_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark)
        if last is not None:
            delete(last)
        last = docs
    return docs


#: Fitted models decide in the first stages, which SQL cannot express.
ORACLE_SQL = None
