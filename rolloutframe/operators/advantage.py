"""Group-relative advantages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_advantage(rollouts: DataFrame, reward: str = "reward", length: str | None = None, alpha: float | None = None, key: str = "example_id", out: str = "advantage") -> DataFrame:
    """Reward less the mean of its example's rewards.

    With ``alpha`` rewards are first divided by 1 + alpha * length / mean length of the example. Both means are windows
    over one partitioning, so the rollouts shuffle once.
    """
    w = Window.partitionBy(key)
    shaped = F.col(reward)
    if alpha is not None:
        shaped = shaped / (1 + F.lit(float(alpha)) * F.col(length) / F.avg(length).over(w))
    rows = rollouts.withColumn("_shaped", shaped)
    return rows.withColumn(out, F.col("_shaped") - F.avg("_shaped").over(w)).drop("_shaped")


def raw_advantage(rollouts: DataFrame, reward: str = "reward", out: str = "advantage") -> DataFrame:
    """The reward itself, for runs without an advantage configuration."""
    return rollouts.withColumn(out, F.col(reward))


def rectangular(rollouts: DataFrame, n: int, key: str = "example_id") -> DataFrame:
    """The rollouts, or an error if some example does not have exactly ``n``."""
    count = F.count("*").over(Window.partitionBy(key))
    return rollouts.withColumn("_ok", F.when(count == n, F.lit(True)).otherwise(F.raise_error(F.format_string("an example has %d rollouts", count)).cast("boolean"))).where("_ok").drop("_ok")


def custom_advantage(rollouts: DataFrame, f: Callable[[Column, Callable[[Column], Column]], Column], reward: str = "reward", key: str = "example_id", out: str = "advantage") -> DataFrame:
    """``f(reward, over)`` as advantage; ``over`` turns an aggregate into its value for the example."""
    w = Window.partitionBy(key)
    return rollouts.withColumn(out, f(F.col(reward), lambda a: a.over(w)))


def normalized(reward: Column, over: Callable[[Column], Column]) -> Column:
    """Centred and divided by the unbiased deviation, for custom_advantage."""
    return (reward - over(F.avg(reward))) / (over(F.stddev_samp(reward)) + F.lit(1e-8))
