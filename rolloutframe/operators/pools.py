"""Difficulty pools, their metrics, and joins of saved pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .ordering import numbered


def assign(rollouts: DataFrame, easy: float | None, hard: float | None, reward: str = "reward") -> DataFrame:
    """env_name, example_id, avg_reward, pool: easy is tested before hard."""
    g = rollouts.groupBy("env_name", "example_id").agg(F.avg(reward).alias("avg_reward"))
    pool = F.lit("normal")
    if hard is not None:
        pool = F.when(F.col("avg_reward") <= hard, "hard").otherwise(pool)
    if easy is not None:
        pool = F.when(F.col("avg_reward") >= easy, "easy").otherwise(pool)
    return g.withColumn("pool", pool)


def online_filter(rollouts: DataFrame, reward: str = "reward") -> DataFrame:
    """Drops the rollouts of examples whose mean reward is exactly 0 or 1."""
    mean = F.avg(reward).over(Window.partitionBy("env_name", "example_id"))
    return rollouts.withColumn("_mean", mean).where("_mean <> 0 and _mean <> 1").drop("_mean")


def metrics(rollouts: DataFrame, easy: float, hard: float, reward: str = "reward", by_env: bool = True) -> DataFrame:
    """Shares of evicted and filtered examples and of the pools, per environment and (env_name null) over all."""
    g = assign(rollouts, easy, hard, reward)
    flag = lambda c: F.avg(c.cast("double"))
    aggs = [
        F.count("*").alias("n_examples"),
        flag(F.col("pool") == "easy").alias("pool_easy"),
        flag(F.col("pool") == "hard").alias("pool_hard"),
        flag(F.col("pool") == "normal").alias("pool_normal"),
        flag(F.col("pool") != "normal").alias("evicted_ratio"),
        flag(F.col("avg_reward").isin(0.0, 1.0)).alias("filtered_ratio"),
    ]
    return (g.rollup("env_name") if by_env else g.groupBy()).agg(*aggs)


def restore(saved: DataFrame, current: DataFrame, hash_keys: list[str]) -> DataFrame:
    """Matches saved examples (with ``pool``) to current ones by the hash of ``hash_keys``.

    The latest saved row of a hash counts; the first environment that holds it wins; each current example is used once.
    """
    digest = F.sha2(F.to_json(F.array(*[F.col(k).cast("string") for k in hash_keys])), 256)
    latest = Window.partitionBy("_hash").orderBy(F.desc("saved_order"))
    s = saved.withColumn("_hash", digest).withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("_hash", "pool")
    first = Window.partitionBy("_hash").orderBy("env_name", F.desc("example_id"))
    c = current.withColumn("_hash", digest).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_hash", "env_name", "example_id")
    return c.join(s, "_hash").drop("_hash")


def probabilities(examples: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """env_name, probability: given ratios renormalised over environments that have examples, else by example count."""
    g = examples.groupBy("env_name").agg(F.count("*").alias("n"))
    weight: Column = F.col("n").cast("double")
    if ratios:
        pairs = [x for k, v in ratios.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("env_name")], F.lit(0.0))
    return g.withColumn("_w", weight).withColumn("probability", F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(0)))).select("env_name", "probability")


def return_fraction(pooled: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Moves round(n * fraction) examples (half to even) of the easy and of the hard pool back to normal, those of the
    least uniform() numbers."""
    drawn = pooled.where(F.col("pool") != "normal").withColumn("_u", uniform(F.col("example_id"), seed))
    sizes = drawn.groupBy("pool").agg(F.bround(F.count("*") * F.lit(float(fraction))).alias("_back"))
    drawn = numbered(drawn, ["_u", "example_id"], "_place", ("pool",)).join(sizes, "pool")
    drawn = drawn.withColumn("pool", F.when(F.col("_place") < F.col("_back"), "normal").otherwise(F.col("pool"))).select(*pooled.columns)
    return pooled.where((F.col("pool") == "normal") | F.col("pool").isNull()).unionByName(drawn)


def sample_envs(draws: DataFrame, probabilities_: DataFrame, seed: int = 0) -> DataFrame:
    """An environment for each draw (column ``draw``), with replacement, by the inverse of the cumulated probabilities.
    Without an environment there are no rows."""
    w = Window.partitionBy(F.lit(0)).orderBy("env_name")
    p = probabilities_.withColumn("hi", F.sum("probability").over(w)).withColumn("lo", F.col("hi") - F.col("probability"))
    p = p.agg(F.sort_array(F.collect_list(F.struct("hi", "env_name"))).alias("p"))
    u = uniform(F.col("draw"), seed)
    pick = F.coalesce(F.get(F.filter("p", lambda x: x["hi"] > F.col("u")), F.lit(0))["env_name"], F.try_element_at("p", F.lit(-1))["env_name"])
    return draws.withColumn("u", u).join(F.broadcast(p.where(F.size("p") > 0))).select("draw", pick.alias("env_name"))


def latest(rollouts: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rollouts in arrival order; n = 0 returns all of them, as taking an empty tail does in the original."""
    return rollouts if n == 0 else rollouts.orderBy(*[F.desc(c) for c in order]).limit(n)


def solve_rate_between(rollouts: DataFrame, low: float, high: float, reward: str = "reward", key: str = "example_id") -> DataFrame:
    """key, rate of the examples whose mean reward is between both bounds, inclusive."""
    return rollouts.groupBy(key).agg(F.avg(reward).alias("rate")).where(F.col("rate").between(low, high))


def fresh(rollouts: DataFrame, most: int, version: str = "version", key: str = "example_id") -> DataFrame:
    """Without the groups that have a request at ``most`` or more off-policy steps; the others are one step older."""
    oldest = F.max(version).over(Window.partitionBy(key))
    return rollouts.withColumn("_m", oldest).where(F.col("_m") < most).drop("_m").withColumn(version, F.col(version) + 1)


def unmatched(saved: DataFrame, current: DataFrame, on: Column) -> DataFrame:
    """The number of saved rows that match no current one."""
    return saved.join(current, on, "left_anti").agg(F.count("*").alias("unmatched"))
