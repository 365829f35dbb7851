"""Queries on rollouts: advantages, pools, metrics, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import advantage, metrics, packing, pools, runs
from ..sources import io
from ..sources.carriers import table, view
from .registry import query, r6

GR3 = """
s AS (SELECT *, reward / (1 + 0.33::DOUBLE * completion_len / avg(completion_len) OVER (PARTITION BY example_id)) AS shaped FROM groups4),
a AS (SELECT *, shaped - avg(shaped) OVER (PARTITION BY example_id) AS advantage FROM s)
"""


@query("D01_group_mean_advantage", "SELECT example_id, rollout_idx, round(reward - avg(reward) OVER (PARTITION BY example_id), 6) + 0.0 AS advantage FROM groups4", ("groups4",))
def d01(spark, d):
    return advantage.group_advantage(view(spark, d, "groups4")).select("example_id", "rollout_idx", r6("advantage").alias("advantage"))


@query("D02_length_shaped_advantage", f"WITH {GR3} SELECT example_id, rollout_idx, round(advantage, 6) + 0.0 AS advantage FROM a", ("groups4",))
def d02(spark, d):
    return advantage.group_advantage(view(spark, d, "groups4"), length="completion_len", alpha=0.33).select("example_id", "rollout_idx", r6("advantage").alias("advantage"))


@query("D03_raw_advantage", "SELECT example_id, rollout_idx, round(reward, 6) AS advantage FROM groups4", ("groups4",))
def d03(spark, d):
    return advantage.rectangular(advantage.raw_advantage(view(spark, d, "groups4")), 4).select("example_id", "rollout_idx", r6("advantage").alias("advantage"))


@query("E01_partition_mean_by_env", f"WITH {GR3} SELECT env_name, round(avg(m), 6) + 0.0 AS mean_spread, count(*) AS n FROM (SELECT env_name, example_id, max(advantage) - min(advantage) AS m FROM a GROUP BY env_name, example_id) GROUP BY env_name", ("groups4",))
def flagship(spark, d):
    a = advantage.group_advantage(view(spark, d, "groups4"), length="completion_len", alpha=0.33)
    per = a.groupBy("env_name", "example_id").agg((F.max("advantage") - F.min("advantage")).alias("m"))
    return per.groupBy("env_name").agg(r6(F.avg("m")).alias("mean_spread"), F.count("*").alias("n"))


@query("L01_custom_advantage", "SELECT example_id, rollout_idx, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-8), 5) + 0.0 AS advantage FROM groups4 WINDOW w AS (PARTITION BY example_id)", ("groups4",))
def l01(spark, d):
    return advantage.custom_advantage(view(spark, d, "groups4"), advantage.normalized).select("example_id", "rollout_idx", (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


@query("D04_pool_assignment", "SELECT env_name, example_id, round(avg(reward_bin), 6) AS avg_reward, CASE WHEN avg(reward_bin) >= 1 THEN 'easy' WHEN avg(reward_bin) <= 0 THEN 'hard' ELSE 'normal' END AS pool FROM rollouts GROUP BY env_name, example_id", ("rollouts",))
def d04(spark, d):
    return pools.assign(view(spark, d, "rollouts"), 1.0, 0.0, "reward_bin").select("env_name", "example_id", r6("avg_reward").alias("avg_reward"), "pool")


POOL_METRICS = """
WITH g AS (SELECT env_name, example_id, avg(reward_bin) AS a FROM rollouts GROUP BY env_name, example_id),
p AS (SELECT *, CASE WHEN a >= 1 THEN 'easy' WHEN a <= 0 THEN 'hard' ELSE 'normal' END AS pool FROM g)
SELECT env_name, count(*) AS n_examples, round(avg((pool = 'easy')::INT), 6) AS pool_easy, round(avg((pool = 'hard')::INT), 6) AS pool_hard, round(avg((pool = 'normal')::INT), 6) AS pool_normal,
round(avg((pool <> 'normal')::INT), 6) AS evicted_ratio, round(avg((a IN (0, 1))::INT), 6) AS filtered_ratio FROM p GROUP BY
"""


@query("D05_env_pool_metrics", POOL_METRICS + "env_name", ("rollouts",))
def d05(spark, d):
    m = pools.metrics(view(spark, d, "rollouts"), 1.0, 0.0, "reward_bin").where("env_name is not null")
    return m.select("env_name", "n_examples", *[r6(c).alias(c) for c in m.columns[2:]])


@query("D06_pool_metrics_rollup", POOL_METRICS + "ROLLUP (env_name)", ("rollouts",))
def d06(spark, d):
    m = pools.metrics(view(spark, d, "rollouts"), 1.0, 0.0, "reward_bin")
    return m.select("env_name", "n_examples", *[r6(c).alias(c) for c in m.columns[2:]])


@query("B05_online_difficulty_filter", "SELECT env_name, example_id, rollout_idx FROM (SELECT *, avg(reward_bin) OVER (PARTITION BY env_name, example_id) AS m FROM rollouts) WHERE m NOT IN (0, 1)", ("rollouts",))
def b05(spark, d):
    return pools.online_filter(view(spark, d, "rollouts"), "reward_bin").select("env_name", "example_id", "rollout_idx")


@query("B06_solve_rate_filter", "SELECT example_id, round(avg(reward_bin), 6) AS rate FROM rollouts GROUP BY example_id HAVING avg(reward_bin) BETWEEN 0.25 AND 0.75", ("rollouts",))
def b06(spark, d):
    return pools.solve_rate_between(view(spark, d, "rollouts"), 0.25, 0.75, "reward_bin").select("example_id", r6("rate").alias("rate"))


@query("F12_env_probabilities", "SELECT env_name, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS probability FROM (SELECT DISTINCT env_name, example_id FROM rollouts) GROUP BY env_name", ("rollouts",))
def f12(spark, d):
    ex = view(spark, d, "rollouts").select("env_name", "example_id").distinct()
    return pools.probabilities(ex).select("env_name", r6("probability").alias("probability"))


@query("F12_env_ratios", "WITH w AS (SELECT DISTINCT env_name, CASE env_name WHEN '1-URGENT' THEN 3.0::DOUBLE WHEN '2-HIGH' THEN 1.0 ELSE 0.0 END AS w FROM rollouts) SELECT env_name, round(w / sum(w) OVER (), 6) AS probability FROM w", ("rollouts",))
def f12b(spark, d):
    ex = view(spark, d, "rollouts").select("env_name", "example_id").distinct()
    return pools.probabilities(ex, {"1-URGENT": 3, "2-HIGH": 1, "absent": 5}).select("env_name", r6("probability").alias("probability"))


@query("F13_return_fraction_counts", "WITH p AS (SELECT example_id, CASE WHEN avg(reward_bin) >= 1 THEN 'easy' WHEN avg(reward_bin) <= 0 THEN 'hard' ELSE 'normal' END AS pool FROM rollouts GROUP BY example_id), c AS (SELECT count(*) FILTER (WHERE pool = 'easy') AS e, count(*) FILTER (WHERE pool = 'hard') AS h, count(*) FILTER (WHERE pool = 'normal') AS n FROM p) SELECT unnest(['easy', 'hard', 'normal']) AS pool, unnest([e - round_even(e * 0.3::DOUBLE, 0), h - round_even(h * 0.3::DOUBLE, 0), n + round_even(e * 0.3::DOUBLE, 0) + round_even(h * 0.3::DOUBLE, 0)])::BIGINT AS n FROM c", ("rollouts",))
def f13(spark, d):
    p = pools.assign(view(spark, d, "rollouts"), 1.0, 0.0, "reward_bin")
    return pools.return_fraction(p, 0.3).groupBy("pool").agg(F.count("*").alias("n"))


@query("F10_weighted_env_draws", "SELECT event_id AS draw, CASE WHEN ('0x' || substr(md5(event_id || '-0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < 0.8::DOUBLE THEN '1-URGENT' ELSE '2-HIGH' END AS env_name FROM events")
def f10(spark, d):
    ex = view(spark, d, "rollouts").select("env_name", "example_id").distinct()
    draws = table(spark, d, "events").select(F.col("event_id").alias("draw"))
    return pools.sample_envs(draws, pools.probabilities(ex, {"1-URGENT": 0.8, "2-HIGH": 0.2})).select("draw", "env_name")


@query("C01_restore_pools", """
WITH s AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_retailprice > 1500 THEN 'easy' ELSE 'hard' END AS pool, p_partkey AS saved_order FROM part),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY saved_order DESC) AS n FROM s) WHERE n = 1),
c AS (SELECT p_brand AS env_name, p_partkey AS example_id, p_brand, p_type FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY env_name, example_id DESC) AS n FROM c) WHERE n = 1)
SELECT f.env_name, f.example_id, l.pool FROM f JOIN l ON f.p_brand = l.p_brand AND f.p_type = l.p_type""")
def c01(spark, d):
    p = table(spark, d, "part")
    saved = p.select("p_brand", "p_type", F.when(F.col("p_retailprice") > 1500, "easy").otherwise("hard").alias("pool"), F.col("p_partkey").alias("saved_order"))
    current = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("env_name"), F.col("p_partkey").alias("example_id"), "p_brand", "p_type")
    return pools.restore(saved, current, ["p_brand", "p_type"]).select("env_name", "example_id", "pool")


@query("C02_unmatched_count", "SELECT count(*) AS unmatched FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def c02(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return pools.unmatched(c, o, c["c_custkey"] == o["o_custkey"])


@query("C03_known_envs_semi_join", "SELECT env_name, count(*) AS n FROM rollouts WHERE env_name IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice > 400000) GROUP BY env_name", ("rollouts",))
def c03(spark, d):
    known = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderpriority").alias("env_name"))
    return io.known_envs(view(spark, d, "rollouts"), known).groupBy("env_name").agg(F.count("*").alias("n"))


@query("C04_run_diff", "SELECT 'deleted' AS kind, c_custkey AS run FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'new', c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def c04(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run"))
    known, present = c.where("run % 3 = 0"), c.where("run % 2 = 0")
    gone, new = runs.changed(known, present)
    return gone.select(F.lit("deleted").alias("kind"), "run").unionByName(new.select(F.lit("new").alias("kind"), "run"))


VALUES = ["completion_len", "prompt_len", "generation_ms", "reward"]


def _two_level_sql(keys: str) -> str:
    inner = ", ".join(f"avg({v}) AS {v}" for v in VALUES)
    outer = ", ".join(f"round({a}({v}), 6) AS {v}_{n}" for v in VALUES for a, n in (("avg", "mean"), ("max", "max"), ("min", "min")))
    g = f" GROUP BY {keys[:-2]}" if keys else ""
    return f"WITH i AS (SELECT {keys}example_id, {inner} FROM rollouts GROUP BY {keys}example_id) SELECT {keys}{outer} FROM i{g}"


@query("D07_two_level_metrics", _two_level_sql(""), ("rollouts",))
def d07(spark, d):
    m = metrics.two_level(view(spark, d, "rollouts"), VALUES)
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("D10_two_level_metrics_by_env", _two_level_sql("env_name, "), ("rollouts",))
def d10(spark, d):
    m = metrics.two_level(view(spark, d, "rollouts"), VALUES, ("env_name",))
    return m.select("env_name", *[r6(c).alias(c) for c in m.columns[1:]])


SOLVE = "WITH i AS (SELECT {0}example_id, sum(reward_bin) AS s, count(*) AS n FROM rollouts GROUP BY {0}example_id) SELECT {0}round(avg((s = 0)::INT), 6) AS solve_none, round(avg((s = n)::INT), 6) AS solve_all, round(1 - avg((s = 0)::INT) - avg((s = n)::INT), 6) AS effective_batch_size FROM i"


@query("D08_solve_rates", SOLVE.format(""), ("rollouts",))
def d08(spark, d):
    m = metrics.solve_rates(view(spark, d, "rollouts"), "reward_bin")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("D10_solve_rates_by_env", SOLVE.format("env_name, ") + " GROUP BY env_name", ("rollouts",))
def d10b(spark, d):
    m = metrics.solve_rates(view(spark, d, "rollouts"), "reward_bin", ("env_name",))
    return m.select("env_name", *[r6(c).alias(c) for c in m.columns[1:]])


@query("D09_stop_condition_shares", "SELECT stop_condition, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM rollouts WHERE stop_condition IS NOT NULL GROUP BY stop_condition", ("rollouts",))
def d09(spark, d):
    return metrics.value_shares(view(spark, d, "rollouts"), "stop_condition").select("stop_condition", r6("share").alias("share"))


@query("D09_env_shares", "SELECT env_name, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM rollouts GROUP BY env_name", ("rollouts",))
def d09b(spark, d):
    return metrics.value_shares(view(spark, d, "rollouts"), "env_name").select("env_name", r6("share").alias("share"))


@query("B17_generation_truncated", "SELECT env_name, round(avg((is_truncated AND stop_condition IS DISTINCT FROM 'prompt_too_long')::INT), 6) AS truncated FROM rollouts GROUP BY env_name", ("rollouts",))
def b17(spark, d):
    flag = metrics.generation_truncated(F.col("is_truncated"), F.col("stop_condition"))
    return view(spark, d, "rollouts").groupBy("env_name").agg(r6(F.avg(flag.cast("double"))).alias("truncated"))


@query("D11_env_metric_means", """
WITH l AS (SELECT env_name, example_id, 'gen' AS metric, generation_ms AS value FROM rollouts UNION ALL SELECT env_name, example_id, 'score', CASE WHEN is_truncated THEN NULL ELSE scoring_ms END FROM rollouts),
i AS (SELECT env_name, metric, example_id, avg(value) AS value FROM l GROUP BY ALL) SELECT env_name, metric, round(avg(value), 6) AS value FROM i GROUP BY env_name, metric""", ("rollouts",))
def d11(spark, d):
    r = view(spark, d, "rollouts").withColumn("metrics", F.create_map(F.lit("gen"), F.col("generation_ms"), F.lit("score"), F.when(~F.col("is_truncated"), F.col("scoring_ms"))))
    return metrics.env_metrics(r).select("env_name", "metric", r6("value").alias("value"))


PASS = """
WITH g AS (SELECT example_id, count(*) AS n, sum(reward_bin)::BIGINT AS c FROM rollouts GROUP BY example_id),
k AS (SELECT *, unnest([1, 2, 4, 8, 16]) AS k FROM g),
p AS (SELECT k, n, c, CASE WHEN c = 0 THEN 0 WHEN n - c < k THEN 1 ELSE 1 - list_product([1.0::DOUBLE - k::DOUBLE / i for i in range(n - c + 1, n + 1)]) END AS p FROM k WHERE k <= n)
SELECT k, round(avg(p), 6) AS pass_at_k FROM p GROUP BY k"""


@query("D13_pass_at_k", PASS, ("rollouts",))
def d13(spark, d):
    return metrics.pass_at_k(view(spark, d, "rollouts"), "reward_bin").select("k", r6("pass_at_k").alias("pass_at_k"))


@query("D14_eval_summary", """
SELECT env_name, round(avg(reward), 6) AS avg_reward, round(avg(completion_len), 6) AS len_mean, round(stddev_samp(completion_len), 6) AS len_std, min(completion_len) AS len_min, max(completion_len) AS len_max,
round(avg(is_truncated::INT), 6) AS truncated, round(avg((scoring_ms > 80)::INT), 6) AS failed, round(avg((completion_len <= 40)::INT), 6) AS no_response, sum((completion_len <= 40)::INT)::BIGINT AS no_response_count FROM rollouts GROUP BY env_name""", ("rollouts",))
def d14(spark, d):
    r = view(spark, d, "rollouts").withColumn("has_error", F.col("scoring_ms") > 80).withColumn("no_response", F.col("completion_len") <= 40)
    m = metrics.eval_summary(r, ("env_name",))
    return m.select("env_name", *[r6(c).alias(c) for c in ("avg_reward", "len_mean", "len_std")], "len_min", "len_max", *[r6(c).alias(c) for c in ("truncated", "failed", "no_response")], "no_response_count")


@query("D15_binary_rewards", "SELECT env_name, bool_and(reward IN (0, 1)) AS is_binary, bool_and(reward_bin IN (0, 1)) AS bin_is_binary FROM rollouts GROUP BY env_name", ("rollouts",))
def d15(spark, d):
    return view(spark, d, "rollouts").groupBy("env_name").agg(metrics.is_binary("reward").alias("is_binary"), metrics.is_binary("reward_bin").alias("bin_is_binary"))


@query("D16_task_success", "SELECT task, round(avg(reward), 6) AS success, round(avg((reward >= 1)::INT), 6) AS hard_success FROM rollouts GROUP BY task", ("rollouts",))
def d16(spark, d):
    m = metrics.success(view(spark, d, "rollouts"))
    return m.select("task", r6("success").alias("success"), r6("hard_success").alias("hard_success"))


@query("D17_distribution", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type")
def d17(spark, d):
    m = metrics.distribution(table(spark, d, "events"), "value", ("event_type",))
    return m.select("event_type", *[r6(c).alias(c) for c in m.columns[1:]])


@query("D29_lag_stats", "SELECT event_type, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS max FROM events GROUP BY event_type")
def d29(spark, d):
    m = metrics.lag_stats(table(spark, d, "events"), "value", ("event_type",))
    return m.select("event_type", *[r6(c).alias(c) for c in m.columns[1:]])


@query("D26_token_counts", "SELECT env_name, sum(completion_len)::BIGINT AS decode_tokens, sum(prompt_len)::BIGINT AS prefill_tokens FROM rollouts GROUP BY env_name", ("rollouts",))
def d26(spark, d):
    return metrics.token_totals(view(spark, d, "rollouts"), "prompt_len", "completion_len")


@query("D27_running_totals", "WITH s AS (SELECT version AS step, sum(completion_len)::BIGINT AS tokens, count(*) AS samples FROM rollouts GROUP BY version) SELECT step, tokens, samples, sum(tokens) OVER (ORDER BY step)::BIGINT AS total_tokens, sum(samples) OVER (ORDER BY step)::BIGINT AS total_samples FROM s", ("rollouts",))
def d27(spark, d):
    s = view(spark, d, "rollouts").groupBy(F.col("version").alias("step")).agg(F.sum("completion_len").alias("tokens"), F.count("*").alias("samples"))
    return metrics.running_totals(s, ["tokens", "samples"])


@query("D28_error_rates", "SELECT env_name, round(count(*) FILTER (WHERE completion_len <= 40)::DOUBLE / greatest(count(*), 1), 6) AS empty, round(count(*) FILTER (WHERE scoring_ms > 80)::DOUBLE / greatest(count(*), 1), 6) AS errored, max(version) AS off_policy_max, round(avg(version), 6) AS off_policy_mean FROM rollouts GROUP BY ROLLUP (env_name)", ("rollouts",))
def d28(spark, d):
    m = metrics.scheduler_rates(view(spark, d, "rollouts"), F.col("completion_len") <= 40, F.col("scoring_ms") > 80, "version")
    return m.select("env_name", r6("empty").alias("empty"), r6("errored").alias("errored"), "off_policy_max", r6("off_policy_mean").alias("off_policy_mean"))


@query("D30_benchmark_describe", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM r WHERE n > 1 GROUP BY event_type")
def d30(spark, d):
    m = metrics.describe_after_first(table(spark, d, "events"), "value", "event_id", ("event_type",))
    return m.select("event_type", *[r6(c).alias(c) for c in m.columns[1:]])


@query("D31_subset_shares", "SELECT lang, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS sample_share, round(sum(n_chars)::DOUBLE / sum(sum(n_chars)) OVER (), 6) AS token_share FROM documents GROUP BY lang")
def d31(spark, d):
    m = metrics.subset_shares(table(spark, d, "documents"), "lang", "n_chars")
    return m.select("lang", r6("sample_share").alias("sample_share"), r6("token_share").alias("token_share"))


@query("D33_load_balance", "WITH t AS (SELECT l_shipdate::DATE AS layer, l_suppkey % 8 AS expert, count(*) AS tokens FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY tokens DESC, expert) AS n FROM t) SELECT layer, round((max(tokens) - avg(tokens)) / avg(tokens), 6) AS violation FROM r WHERE n > 1 GROUP BY layer")
def d33(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("layer"), (F.col("l_suppkey") % 8).alias("expert")).agg(F.count("*").alias("tokens"))
    return metrics.load_balance(t, ("layer",), 1).select("layer", r6("violation").alias("violation"))


@query("D34_expert_histogram", "SELECT r.range AS expert, count(l_suppkey) AS tokens FROM range(128) r LEFT JOIN lineitem ON l_suppkey % 128 = r.range GROUP BY r.range")
def d34(spark, d):
    return metrics.histogram(table(spark, d, "lineitem").withColumn("e", F.col("l_suppkey") % 128), "e", 128)


@query("D37_even_odd_means", "SELECT round(avg(reward) FILTER (WHERE rollout_idx % 2 = 0), 6) AS off_policy, round(avg(reward) FILTER (WHERE rollout_idx % 2 = 1), 6) AS on_policy FROM rollouts", ("rollouts",))
def d37(spark, d):
    m = metrics.even_odd(view(spark, d, "rollouts"), "reward", "rollout_idx")
    return m.select(r6("off_policy").alias("off_policy"), r6("on_policy").alias("on_policy"))


@query("D38_privileged_means", "SELECT round(coalesce(sum(reward) FILTER (WHERE is_truncated), 0) / greatest(count(*) FILTER (WHERE is_truncated), 1), 6) AS privileged, round(coalesce(sum(reward) FILTER (WHERE NOT is_truncated), 0) / greatest(count(*) FILTER (WHERE NOT is_truncated), 1), 6) AS regular FROM rollouts", ("rollouts",))
def d38(spark, d):
    return view(spark, d, "rollouts").agg(r6(metrics.safe_mean(F.col("reward"), F.col("is_truncated"))).alias("privileged"), r6(metrics.safe_mean(F.col("reward"), ~F.col("is_truncated"))).alias("regular"))


@query("D39_task_mean_rewards", "SELECT version, task, round(avg(reward), 6) AS reward FROM rollouts GROUP BY version, task", ("rollouts",))
def d39(spark, d):
    return metrics.task_means(view(spark, d, "rollouts"), "version").select("version", "task", r6("reward").alias("reward"))


@query("D40_throughput", "SELECT version, round(sum(completion_len) / (sum(generation_ms) / 1000), 6) AS tokens_per_s, round(count(*) / (sum(generation_ms) / 60000), 6) AS samples_per_min, round(avg(completion_len), 6) AS mean_len FROM rollouts GROUP BY version", ("rollouts",))
def d40(spark, d):
    m = metrics.throughput(view(spark, d, "rollouts"), "version", "completion_len", "generation_ms")
    return m.select("version", *[r6(c).alias(c) for c in m.columns[1:]])


@query("D41_distinct_examples", "SELECT env_name, count(DISTINCT example_id) AS examples, count(DISTINCT client) AS clients FROM rollouts GROUP BY env_name", ("rollouts",))
def d41(spark, d):
    return view(spark, d, "rollouts").groupBy("env_name").agg(F.count_distinct("example_id").alias("examples"), F.count_distinct("client").alias("clients"))


@query("D42_zero_ratio", "SELECT l_returnflag, round(count(*) FILTER (WHERE l_discount = 0)::DOUBLE / greatest(count(*), 1), 6) AS zero_ratio FROM lineitem GROUP BY l_returnflag")
def d42(spark, d):
    return metrics.zero_ratio(table(spark, d, "lineitem"), "l_discount", "l_returnflag").select("l_returnflag", r6("zero_ratio").alias("zero_ratio"))


@query("D43_least_loaded_client", "WITH n AS (SELECT s_suppkey AS client, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linestatus = 'O' GROUP BY s_suppkey) SELECT client, n FROM n ORDER BY n, client LIMIT 1")
def d43(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("client"))
    return metrics.least_loaded(c, table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("client")))


@query("D44_normalized_shares", "SELECT env_name, CASE WHEN sum(sum(reward_bin)) OVER () = 0 THEN 0 ELSE round(sum(reward_bin) / sum(sum(reward_bin)) OVER (), 6) END AS share FROM rollouts GROUP BY env_name", ("rollouts",))
def d44(spark, d):
    g = view(spark, d, "rollouts").groupBy("env_name").agg(F.sum("reward_bin").alias("r"))
    return g.select("env_name", r6(metrics.normalize(F.col("r"), Window.partitionBy(F.lit(0)))).alias("share"))


@query("D45_mean_or_zero", "SELECT round(coalesce(avg(reward), 0), 6) AS mean, coalesce(avg(reward) FILTER (WHERE completion_len < 0), 0)::DOUBLE AS empty_mean FROM rollouts", ("rollouts",))
def d45(spark, d):
    empty = F.when(F.col("completion_len") < 0, F.col("reward"))
    return view(spark, d, "rollouts").agg(r6(metrics.mean_or_zero(F.col("reward"))).alias("mean"), metrics.mean_or_zero(empty).alias("empty_mean"))


@query("E04_rolling_throughput", """
WITH s AS (SELECT event_id, value AS tokens, epoch_us(ts) / 1e6 AS t FROM events), w AS (SELECT event_id, sum(tokens) OVER w AS st, first_value(tokens) OVER w AS ft, t - first_value(t) OVER w AS dt, count(*) OVER w AS n FROM s WINDOW w AS (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n > 1 THEN round((st - ft) / nullif(dt, 0), 5) END AS throughput FROM w""")
def e04(spark, d):
    s = table(spark, d, "events").select("event_id", F.col("value").alias("tokens"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return metrics.rolling_throughput(s, 10, "tokens", "t", "event_id").select("event_id", F.round("throughput", 5).alias("throughput"))


@query("E10_latest_rollouts", "SELECT example_id, rollout_idx FROM rollouts ORDER BY version DESC, example_id DESC, rollout_idx DESC LIMIT 100", ("rollouts",))
def e10(spark, d):
    return pools.latest(view(spark, d, "rollouts"), 100, ["version", "example_id", "rollout_idx"]).select("example_id", "rollout_idx")


@query("E11_checkpoint_retention", "SELECT o_custkey AS run, o_orderkey AS step FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 2 OR o_orderkey % 10 = 0")
def e11(spark, d):
    return runs.retained(table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step")), 2, 10)


@query("B15_staleness_filter", "SELECT example_id, rollout_idx, version + 1 AS version FROM (SELECT *, max(version) OVER (PARTITION BY example_id) AS m FROM rollouts) WHERE m < 6", ("rollouts",))
def b15(spark, d):
    return pools.fresh(view(spark, d, "rollouts"), 6).select("example_id", "rollout_idx", "version")


@query("B14_dropped_rollouts", "SELECT env_name, count(*) FILTER (WHERE completion_len <= 40) AS empty, count(*) FILTER (WHERE scoring_ms > 80) AS errored, count(*) FILTER (WHERE completion_len > 40 AND scoring_ms <= 80) AS kept FROM rollouts GROUP BY env_name", ("rollouts",))
def b14(spark, d):
    return metrics.dropped_counts(view(spark, d, "rollouts"), F.col("completion_len") <= 40, F.col("scoring_ms") > 80)


@query("F06_token_target_cut", "SELECT example_id, rollout_idx FROM (SELECT *, coalesce(sum(completion_len) OVER (ORDER BY example_id, rollout_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rollouts) WHERE before < 100000", ("rollouts",))
def f06(spark, d):
    return packing.enough_at(view(spark, d, "rollouts"), ["example_id", "rollout_idx"], "completion_len", 100_000).select("example_id", "rollout_idx")
