"""Metric aggregations over rollouts, evaluations, steps and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import between, lower, order_statistics, upper

from .ordering import framed

ONE = F.lit


def two_level(rollouts: DataFrame, values: list[str], keys: tuple[str, ...] = (), example: str = "example_id") -> DataFrame:
    """Mean, max and min over examples of each example's mean, for every value column (max and min are of the means)."""
    inner = rollouts.groupBy(*keys, example).agg(*[F.avg(v).alias(v) for v in values])
    out = []
    for v in values:
        out += [F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max"), F.min(v).alias(f"{v}_min")]
    return inner.groupBy(*keys).agg(*out)


def solve_rates(rollouts: DataFrame, reward: str, keys: tuple[str, ...] = (), example: str = "example_id") -> DataFrame:
    """Shares of examples with no and with all rollouts solved, and of the rest."""
    inner = rollouts.groupBy(*keys, example).agg(F.sum(reward).alias("s"), F.count("*").alias("n"))
    none, every = F.avg((F.col("s") == 0).cast("double")), F.avg((F.col("s") == F.col("n")).cast("double"))
    return inner.groupBy(*keys).agg(none.alias("solve_none"), every.alias("solve_all")).withColumn("effective_batch_size", 1 - F.col("solve_none") - F.col("solve_all"))


def value_shares(rows: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of each value among the non-null ones."""
    g = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return g.select(*keys, column, (F.col("n") / F.sum("n").over(total)).alias("share"))


def generation_truncated(truncated: Column, stop: Column) -> Column:
    """Truncated for another reason than a long prompt; a null reason counts as another."""
    return truncated & ~stop.eqNullSafe(F.lit("prompt_too_long"))


def env_metrics(rollouts: DataFrame, metrics: str = "metrics", keys: tuple[str, ...] = ("env_name",), example: str = "example_id") -> DataFrame:
    """Mean of example means for every key of a metrics map; nulls are skipped at both levels."""
    long = rollouts.select(*keys, example, F.explode(metrics).alias("metric", "value"))
    inner = long.groupBy(*keys, "metric", example).agg(F.avg("value").alias("value"))
    return inner.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))


def pass_at(n: Column, c: Column, k: Column) -> Column:
    """Unbiased pass@k of c successes in n: one less the product of (1 - k / i), i from n - c + 1 to n."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - k / i))
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - product)


def pass_at_k(rollouts: DataFrame, reward: str, keys: tuple[str, ...] = (), example: str = "example_id") -> DataFrame:
    """Mean pass@k over examples, k the powers of two up to each example's number of rollouts."""
    g = rollouts.groupBy(*keys, example).agg(F.count("*").cast("int").alias("n"), F.sum((F.col(reward) == 1).cast("int")).cast("int").alias("c"))
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("n"))).cast("int")), lambda i: F.pow(F.lit(2.0), i).cast("int"))
    g = g.withColumn("k", F.explode(powers))
    return g.withColumn("p", pass_at(F.col("n"), F.col("c"), F.col("k"))).groupBy(*keys, "k").agg(F.avg("p").alias("pass_at_k"))


def is_binary(reward: str) -> Column:
    """Whether all non-null rewards are 0 or 1."""
    return F.bool_and(F.col(reward).isin(0.0, 1.0))


def eval_summary(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """avg@k, completion length statistics, truncation, failures and missing responses of evaluation rows."""
    return rows.groupBy(*keys).agg(
        F.avg("reward").alias("avg_reward"), F.avg("completion_len").alias("len_mean"), F.stddev_samp("completion_len").alias("len_std"),
        F.min("completion_len").alias("len_min"), F.max("completion_len").alias("len_max"), F.avg(F.col("is_truncated").cast("double")).alias("truncated"),
        F.avg(F.col("has_error").cast("double")).alias("failed"), F.avg(F.col("no_response").cast("double")).alias("no_response"), F.sum(F.col("no_response").cast("long")).alias("no_response_count"),
    )


def _with_statistics(rows: DataFrame, keys: tuple[str, ...], aggregates: list[Column], statistics: DataFrame) -> DataFrame:
    """Aggregates of each key joined with its order statistics."""
    same = F.lit(True)
    for c in keys:
        same &= F.col(f"a.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    return rows.groupBy(*keys).agg(*aggregates).alias("a").join(statistics.alias("s"), same)


def distribution(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, lower median, sample deviation, extremes; NaN where there is nothing."""
    nan = F.lit(float("nan"))
    s = order_statistics(rows, value, keys, {"median": lower(0.5)})
    out = _with_statistics(rows, keys, [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")], s)
    return out.select(*[F.col(f"a.`{c}`").alias(c) for c in keys], *[F.coalesce(F.col(c).cast("double"), nan).alias(c) for c in ("mean", "median", "std", "min", "max")])


def lag_stats(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Least, mean, median, 90th percentile (linear) and largest lag."""
    s = order_statistics(rows, value, keys, {"m0": lower(0.5), "m1": upper(0.5), "p0": lower(0.9), "p1": upper(0.9)})
    out = _with_statistics(rows, keys, [F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")], s)
    return out.select(*[F.col(f"a.`{c}`").alias(c) for c in keys], "min", "mean", between(0.5, F.col("m0"), F.col("m1")).alias("median"), between(0.9, F.col("p0"), F.col("p1")).alias("p90"), "max")


def safe_mean(value: Column, mask: Column) -> Column:
    """Sum under the mask over its size, at least 1."""
    return F.coalesce(F.sum(F.when(mask, value)), F.lit(0.0)) / F.greatest(F.count_if(mask), F.lit(1))


def running_totals(steps: DataFrame, values: list[str], order: str = "step") -> DataFrame:
    """Values with their running totals as total_<value>."""
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("*", *[F.sum(v).over(w).alias(f"total_{v}") for v in values])


def rolling_throughput(steps: DataFrame, window: int, tokens: str, time: str, order: str) -> DataFrame:
    """Tokens after the first of the last ``window`` steps over the time between first and last; null for one step."""
    rows, w = framed(steps, [order], window - 1)
    spent = F.col(time) - F.first(time).over(w)
    rate = (F.sum(tokens).over(w) - F.first(tokens).over(w)) / F.when(F.count("*").over(w) > 1, F.nullif(spent, F.lit(0.0)))
    return rows.withColumn("throughput", rate).where("_own").drop("_own", "_block", "_place")


def validation_mean(batches: DataFrame, loss: str = "loss_sum", tokens: str = "n_tokens", keys: tuple[str, ...] = ()) -> DataFrame:
    """mean, nan_count: loss over tokens of the batches without a NaN, which leave both sums; NaN without a token."""
    bad = F.isnan(loss)
    n = F.coalesce(F.sum(F.when(~bad, F.col(tokens))), F.lit(0))
    mean = F.when(n > 0, F.sum(F.when(~bad, F.col(loss))) / F.nullif(n, F.lit(0))).otherwise(F.lit(float("nan")))
    return batches.groupBy(*keys).agg(mean.alias("mean"), F.count_if(bad).alias("nan_count"))


def log_z(rollouts: DataFrame, reward: Column, reference: Column, own: Column, beta: float, key: str = "example_id") -> DataFrame:
    """Mean over an example's rollouts of reward + beta * (reference - own), both summed log probabilities under one mask."""
    return rollouts.groupBy(key).agg(F.avg(reward + beta * (reference - own)).alias("log_z"))


def spread(rows: DataFrame, metrics: str, names: list[str]) -> DataFrame:
    """Metrics of a JSON object as columns of their own row."""
    return rows.select("*", *[F.get_json_object(metrics, f"$.{n}").try_cast("double").alias(n) for n in names])


def normalize(value: Column, w) -> Column:
    """Shares of the sum, 0 where the sum is 0."""
    total = F.sum(value).over(w)
    return F.when(total == 0, F.lit(0.0)).otherwise(value / total)


def load_balance(tokens: DataFrame, keys: tuple[str, ...], drop: int = 0, count: str = "tokens") -> DataFrame:
    """(max - mean) / mean of tokens per expert without the ``drop`` largest."""
    w = Window.partitionBy(*keys).orderBy(F.desc(count), "expert")
    kept = tokens.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > drop)
    return kept.groupBy(*keys).agg(((F.max(count) - F.avg(count)) / F.avg(count)).alias("violation"))


def histogram(rows: DataFrame, expert: str, n: int) -> DataFrame:
    """Rows per expert, with zeros for unused ones."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(expert).cast("long").alias("expert")).agg(F.count("*").alias("tokens"))
    return spark.range(n).withColumnRenamed("id", "expert").join(counts, "expert", "left").fillna(0, ["tokens"])


def least_loaded(clients: DataFrame, inflight: DataFrame, key: str = "client") -> DataFrame:
    """The client with the fewest requests in flight, ties to the smaller name."""
    load = clients.join(inflight.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])
    return load.agg(F.min_by(key, F.struct("n", key)).alias(key), F.min("n").alias("n"))


def describe_after_first(rows: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, deviation and extremes without the first (warm-up) row of each key; ``order`` tells a key's rows apart."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    same = F.col(f"r.{order}") > F.col("f._first")
    for c in keys:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    rest = rows.alias("r").join(first.alias("f"), same).select("r.*")
    return rest.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def kept_key(key: Column, dropped_prefixes: tuple[str, ...], kept_suffixes: tuple[str, ...]) -> Column:
    """Whether a metric is kept: none of the prefixes, one of the suffixes."""
    out = F.lit(False)
    for x in kept_suffixes:
        out |= key.endswith(x)
    for x in dropped_prefixes:
        out &= ~key.startswith(x)
    return out


def dropped_counts(rollouts: DataFrame, empty: Column, errored: Column, keys: tuple[str, ...] = ("env_name",)) -> DataFrame:
    """Empty, errored and kept rollouts of each environment."""
    return rollouts.groupBy(*keys).agg(F.count_if(empty).alias("empty"), F.count_if(errored).alias("errored"), F.count_if(~empty & ~errored).alias("kept"))


def success(rollouts: DataFrame, reward: str = "reward", key: str = "task") -> DataFrame:
    """Mean reward, and share of rewards of at least 1, of each task."""
    return rollouts.groupBy(key).agg(F.avg(reward).alias("success"), F.avg((F.col(reward) >= 1).cast("double")).alias("hard_success"))


def loss_scale(tokens: Column, counted: Column) -> Column:
    """Counted tokens, at least 1."""
    return F.greatest(F.sum(F.when(counted, tokens)), F.lit(1))


def token_totals(rollouts: DataFrame, prompt: str, completion: str, keys: tuple[str, ...] = ("env_name",)) -> DataFrame:
    """Decoded and prefilled tokens."""
    return rollouts.groupBy(*keys).agg(F.sum(completion).alias("decode_tokens"), F.sum(prompt).alias("prefill_tokens"))


def scheduler_rates(rollouts: DataFrame, empty: Column, errored: Column, off_policy: str) -> DataFrame:
    """Empty and errored shares and off-policy steps of each environment, and (env_name null) of all."""
    n = F.greatest(F.count("*"), F.lit(1))
    return rollouts.rollup("env_name").agg((F.count_if(empty) / n).alias("empty"), (F.count_if(errored) / n).alias("errored"), F.max(off_policy).alias("off_policy_max"), F.avg(off_policy).alias("off_policy_mean"))


def subset_shares(samples: DataFrame, subset: str, tokens: str) -> DataFrame:
    """Shares of samples and tokens of each subset; no rows for a single subset."""
    w = Window.partitionBy(F.lit(0))
    g = samples.groupBy(subset).agg(F.count("*").alias("_n"), F.sum(tokens).alias("_t")).withColumn("_k", F.count("*").over(w))
    return g.where("_k >= 2").select(subset, (F.col("_n") / F.sum("_n").over(w)).alias("sample_share"), (F.col("_t") / F.sum("_t").over(w)).alias("token_share"))


def eviction_counts(evicted: Column) -> tuple[Column, Column]:
    """(number of events, evicted tokens) of a group of rows; ``evicted``: an event's tokens, null where a row is none."""
    return F.count(evicted), F.coalesce(F.sum(evicted), F.lit(0)).cast("long")


def even_odd(rollouts: DataFrame, value: str, index: str) -> DataFrame:
    """Means of the even rows (off-policy) and of the odd ones (on-policy)."""
    even = F.pmod(index, F.lit(2)) == 0
    return rollouts.agg(F.avg(F.when(even, F.col(value))).alias("off_policy"), F.avg(F.when(~even, F.col(value))).alias("on_policy"))


def task_means(rollouts: DataFrame, batch: str, reward: str = "reward", task: str = "task") -> DataFrame:
    """Mean reward of each task in each batch."""
    return rollouts.groupBy(batch, task).agg(F.avg(reward).alias(reward))


def throughput(rollouts: DataFrame, key: str, tokens: str, milliseconds: str) -> DataFrame:
    """tokens_per_s, samples_per_min, mean_len of each key."""
    s = F.sum(milliseconds)
    return rollouts.groupBy(key).agg((F.sum(tokens) / (s / 1000)).alias("tokens_per_s"), (F.count("*") / (s / 60000)).alias("samples_per_min"), F.avg(tokens).alias("mean_len"))


def zero_ratio(tracked: DataFrame, value: str, key: str) -> DataFrame:
    """Share of zeros among the tracked values."""
    return tracked.groupBy(key).agg((F.count_if(F.col(value) == 0) / F.greatest(F.count("*"), F.lit(1))).alias("zero_ratio"))


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def pad_ratio(length: str) -> tuple[Column, Column]:
    """(useful, padded) shares of a stack's area: aggregates over its rows."""
    useful = F.sum(length) / (F.max(length) * F.count("*"))
    return useful, 1 - useful


def over_ranks(rows: DataFrame, index: str, length: str, stackable: Column) -> DataFrame:
    """The longest length, and whether all ranks can stack, at each index."""
    return rows.groupBy(index).agg(F.max(length).alias("length"), F.bool_and(stackable).alias("stackable"))


def longest_streak(rows: DataFrame, key: str, order: str, hot: Column) -> DataFrame:
    """The longest run of hot rows of each key, by gaps and islands."""
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("_hot", hot.cast("int")).withColumn("_island", F.sum(F.when(hot, 0).otherwise(1)).over(w))
    streak = F.sum("_hot").over(Window.partitionBy(key, "_island").orderBy(order))
    return r.withColumn("_s", streak).groupBy(key).agg(F.max("_s").alias("longest"))


def first_detection(rows: DataFrame, key: str, index: str, detected: Column) -> DataFrame:
    """The first index of each key that is detected; null where none is."""
    return rows.groupBy(key).agg(F.min(F.when(detected, F.col(index))).alias("index"))


def first_over(records: DataFrame, value: str, threshold: float, call: Column, start: str) -> DataFrame:
    """The first record at or above a threshold, by call (nulls last) and start."""
    return records.where(F.col(value) >= threshold).orderBy(call.asc_nulls_last(), start).limit(1)
