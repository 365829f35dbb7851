"""Queries on tokens: filters, policy loss, distillation, selections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics, packing, runs
from ..operators import tokens as T
from ..sources.carriers import table, view
from .registry import query, r6

SQL = """tokens AS (
  SELECT seq_id, pos, token_id, -(token_id % 1000) / 100.0::DOUBLE AS inference, -(token_id % 1000) / 100.0::DOUBLE + ((token_id % 7) - 3) / 50.0::DOUBLE AS trainer, pos % 3 <> 0 AS mask,
    coalesce(quality, 0)::DOUBLE - coalesce(toxic, 0)::DOUBLE - 0.5::DOUBLE AS advantage
  FROM (SELECT doc_id AS seq_id, unnest(range(len(w))) AS pos, (('0x' || substr(md5(unnest(w)), 1, 6))::BIGINT) % 128000 AS token_id FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) x
  LEFT JOIN labels l ON l.doc_id = x.seq_id)"""


def tokens(spark, d) -> DataFrame:
    """Documents as token rows; the label join is on the sequence before the words are spread out."""
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    adv = F.coalesce("quality", F.lit(0)).cast("double") - F.coalesce("toxic", F.lit(0)).cast("double") - 0.5
    t = docs.select(F.col("doc_id").alias("seq_id"), adv.alias("advantage"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    t = t.withColumn("token_id", F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("long") % 128000)
    t = t.withColumn("inference", -(F.col("token_id") % 1000) / F.lit(100.0)).withColumn("trainer", F.col("inference") + ((F.col("token_id") % 7) - 3) / F.lit(50.0))
    return t.withColumn("mask", F.col("pos") % 3 != 0).withColumn("logprob", F.col("inference")).drop("word")


GIB = (100_000, 128_000, -3.0)
GIB_LIMIT = -math.log(128_000) + 3.0


@query("B01_gibberish_filter", f"WITH {SQL} SELECT seq_id, min(CASE WHEN token_id > 100000 AND inference < {GIB_LIMIT!r} THEN pos END)::INT AS index FROM tokens GROUP BY seq_id")
def b01(spark, d):
    return T.first_gibberish(tokens(spark, d), *GIB)


REP = f"{math.log(0.01)!r}"


@query("B02_repetition_filter", f"""WITH {SQL}, h AS (SELECT seq_id, pos, (inference > {REP})::INT AS hot, sum(CASE WHEN inference > {REP} THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY pos) AS island FROM tokens),
s AS (SELECT *, sum(hot) OVER (PARTITION BY seq_id, island ORDER BY pos) AS streak FROM h) SELECT seq_id, min(CASE WHEN streak >= 4 THEN pos END)::INT AS index FROM s GROUP BY seq_id""")
def b02(spark, d):
    a = _arrays(spark, d)
    return a.select("seq_id", T.repetition_index(F.col("lp"), 4, 0.01).alias("index"))


def _arrays(spark, d):
    """A document's tokens as arrays of its own row."""
    ids = F.transform(F.split("text", " "), lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % 128000)
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("seq_id"), ids.alias("ids"))
    return t.select("seq_id", "ids", F.transform("ids", lambda x: -(x % 1000) / F.lit(100.0)).alias("lp"), F.transform("ids", lambda x: F.lit(True)).alias("completion_mask"), F.lit(None).cast("string").alias("stop_condition"))


@query("B04_filters_in_order", f"""WITH {SQL}, g AS (SELECT seq_id, min(CASE WHEN token_id > 100000 AND inference < {GIB_LIMIT!r} THEN pos END) AS i, count(*) AS n FROM tokens GROUP BY seq_id),
h AS (SELECT seq_id, pos, (inference > {REP})::INT AS hot, sum(CASE WHEN inference > {REP} THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY pos) AS island FROM tokens),
s AS (SELECT *, sum(hot) OVER (PARTITION BY seq_id, island ORDER BY pos) AS streak FROM h), r AS (SELECT seq_id, min(CASE WHEN streak >= 4 THEN pos END) AS i FROM s GROUP BY seq_id)
SELECT g.seq_id, CASE WHEN g.i IS NOT NULL THEN 'gibberish' WHEN r.i IS NOT NULL THEN 'repetition' END AS detected_by, CASE WHEN g.i IS NOT NULL THEN 'gibberish' END AS stop_condition, CASE WHEN g.i IS NOT NULL THEN 0 ELSE g.n END::INT AS trained FROM g JOIN r USING (seq_id)""")
def b04(spark, d):
    a = _arrays(spark, d)
    found = [("gibberish", T.gibberish_index(F.col("ids"), F.col("lp"), *GIB).isNotNull(), True), ("repetition", T.repetition_index(F.col("lp"), 4, 0.01).isNotNull(), False)]
    return T.apply_filters(a, found).select("seq_id", "detected_by", "stop_condition", F.size(F.filter("completion_mask", lambda x: x)).alias("trained"))


@query("D12_filter_rates", f"WITH {SQL}, g AS (SELECT seq_id, count(*) FILTER (WHERE token_id > 100000 AND inference < {GIB_LIMIT!r}) > 0 AS hit FROM tokens GROUP BY seq_id) SELECT sum(hit::INT)::BIGINT AS detected, round(avg(hit::INT), 6) AS rate FROM g")
def d12(spark, d):
    hit = F.col("index").isNotNull()
    return T.first_gibberish(tokens(spark, d), *GIB).agg(F.count_if(hit).alias("detected"), r6(F.avg(hit.cast("double"))).alias("rate"))


LOSS = f"""WITH {SQL},
a AS (SELECT *, exp(trainer) - exp(inference) AS pd, trainer - inference AS de FROM tokens),
b AS (SELECT *, CASE WHEN advantage > 0 THEN pd > 0.2 ELSE pd < -0.2 END AS invalid, exp(de) - de - 1 AS kl FROM a),
c AS (SELECT *, mask AND NOT invalid AS keep, CASE WHEN mask AND NOT invalid THEN -advantage * exp(de) ELSE 0 END + CASE WHEN mask THEN 0.001 * de * de ELSE 0 END AS loss FROM b)"""


@query("D19_policy_loss", LOSS + """ SELECT seq_id, round(sum(loss), 5) + 0.0 AS loss, round(coalesce(sum(kl) FILTER (WHERE mask), 0) / greatest(count(*) FILTER (WHERE mask), 1), 6) + 0.0 AS mismatch_kl,
round(coalesce(sum(kl) FILTER (WHERE keep), 0) / greatest(count(*) FILTER (WHERE keep), 1), 6) + 0.0 AS unmasked_mismatch_kl, round(coalesce(sum(invalid::INT) FILTER (WHERE mask), 0) / greatest(count(*) FILTER (WHERE mask), 1), 6) + 0.0 AS is_masked,
count(*) FILTER (WHERE mask) AS n_tokens FROM c GROUP BY seq_id""")
def d19(spark, d):
    return T.policy_loss(tokens(spark, d)).select("seq_id", (F.round("loss", 5) + F.lit(0.0)).alias("loss"), *[r6(c).alias(c) for c in ("mismatch_kl", "unmasked_mismatch_kl", "is_masked")], "n_tokens")


@query("D21_batch_loss", LOSS + " SELECT round(sum(loss) / greatest(count(*) FILTER (WHERE mask), 1), 6) AS loss, greatest(count(*) FILTER (WHERE mask), 1) AS loss_scale FROM c")
def d21(spark, d):
    b = T.batch_loss(T.policy_loss(tokens(spark, d)))
    return b.select(r6("loss").alias("loss"), "loss_scale")


@query("D20_masked_nll", f"WITH {SQL} SELECT seq_id, round(coalesce(sum(-trainer) FILTER (WHERE mask), 0), 5) + 0.0 AS nll, count(*) FILTER (WHERE mask) AS n_tokens FROM tokens GROUP BY seq_id")
def d20(spark, d):
    return T.masked_nll(tokens(spark, d)).select("seq_id", (F.round("nll", 5) + F.lit(0.0)).alias("nll"), "n_tokens")


@query("D18_masked_mean", f"WITH {SQL} SELECT seq_id % 10 AS shard, round(coalesce(sum(trainer) FILTER (WHERE mask), 0) / greatest(count(*) FILTER (WHERE mask), 1), 6) AS mean FROM tokens GROUP BY shard")
def d18(spark, d):
    return tokens(spark, d).groupBy((F.col("seq_id") % 10).alias("shard")).agg(r6(T.masked_mean(F.col("trainer"), F.col("mask"))).alias("mean"))


@query("D49_token_weighted_mismatch", LOSS + " SELECT round(avg(kl) FILTER (WHERE mask), 6) AS all_kl, round(avg(kl) FILTER (WHERE keep), 6) AS unmasked_kl, round(avg(de) FILTER (WHERE mask), 6) AS delta, round(avg(pd) FILTER (WHERE mask), 6) AS prob_delta FROM c")
def d49(spark, d):
    t = T.loss_columns(tokens(spark, d))
    on = lambda c, m: r6(F.avg(F.when(F.col(m), F.col(c))))
    return t.agg(on("mismatch_kl", "mask").alias("all_kl"), on("mismatch_kl", "keep").alias("unmasked_kl"), on("delta", "mask").alias("delta"), on("prob_delta", "mask").alias("prob_delta"))


@query("D24_token_weighted_sft_loss", f"WITH {SQL}, m AS (SELECT seq_id, CASE WHEN seq_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE coalesce(sum(-trainer) FILTER (WHERE mask), 0) END AS l, count(*) FILTER (WHERE mask) AS n FROM tokens GROUP BY seq_id) SELECT round(sum(CASE WHEN isnan(l) THEN 0 ELSE l END) / sum(n), 6) AS train, round(sum(l) FILTER (WHERE NOT isnan(l)) / sum(n) FILTER (WHERE NOT isnan(l)), 6) AS validation FROM m")
def d24(spark, d):
    m = T.masked_nll(tokens(spark, d)).withColumn("l", F.when(F.col("seq_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("nll")))
    bad = F.isnan("l")
    zero = F.when(bad, F.lit(0.0)).otherwise(F.col("l"))
    return m.agg(r6(F.sum(zero) / F.sum("n_tokens")).alias("train"), r6(F.sum(zero) / F.sum(F.when(~bad, F.col("n_tokens")))).alias("validation"))


@query("D23_kl_entropy_ratio", f"WITH {SQL}, s AS (SELECT seq_id, avg(exp(trainer - inference) - (trainer - inference) - 1) AS kl, avg(-trainer) AS e FROM tokens GROUP BY seq_id) SELECT seq_id, CASE WHEN e > 0 THEN round(kl / e, 6) + 0.0 END AS ratio FROM s")
def d23(spark, d):
    t = T.loss_columns(tokens(spark, d)).groupBy("seq_id").agg(F.avg("mismatch_kl").alias("kl"), F.avg(-F.col("trainer")).alias("e"))
    return t.select("seq_id", F.when(F.col("e") > 0, r6(F.col("kl") / F.col("e"))).alias("ratio"))


@query("F02_top_mismatch_tokens", LOSS + " SELECT seq_id, pos::INT AS pos, round(kl, 9) + 0.0 AS kl FROM c WHERE mask ORDER BY round(kl, 9) DESC, seq_id, pos LIMIT 50")
def f02(spark, d):
    t = T.loss_columns(tokens(spark, d)).withColumn("mismatch_kl", F.round("mismatch_kl", 9) + F.lit(0.0))
    return T.top_mismatch(t, 50).select("seq_id", "pos", F.col("mismatch_kl").alias("kl"))


@query("F02_top_mismatch_per_sequence", LOSS + ", r AS (SELECT seq_id, pos::INT AS pos, round(kl, 9) + 0.0 AS kl, row_number() OVER (PARTITION BY seq_id ORDER BY round(kl, 9) DESC, pos) AS n FROM c WHERE keep) SELECT seq_id, pos, kl FROM r WHERE n <= 3")
def f02b(spark, d):
    t = T.loss_columns(tokens(spark, d)).withColumn("mismatch_kl", F.round("mismatch_kl", 9) + F.lit(0.0))
    return T.top_mismatch(t, 3, "keep", "seq_id").select("seq_id", "pos", F.col("mismatch_kl").alias("kl"))


@query("F05_top_k_logprobs", f"WITH {SQL}, r AS (SELECT seq_id, list_sort(list(inference), 'DESC')[:5] AS top FROM tokens GROUP BY seq_id) SELECT seq_id, round(list_sum(list_transform(top, lambda x: exp(x))), 6) AS mass, round(top[1], 6) + 0.0 AS best FROM r")
def f05(spark, d):
    a = tokens(spark, d).groupBy("seq_id").agg(F.collect_list("inference").alias("lp")).select("seq_id", T.top_k(F.col("lp"), 5).alias("top"))
    return a.select("seq_id", r6(F.aggregate("top", F.lit(0.0), lambda s, x: s + F.exp(x))).alias("mass"), r6(F.get("top", F.lit(0))).alias("best"))


@query("E15_label_shift", f"WITH {SQL} SELECT seq_id, pos::INT AS pos, lead(token_id, 1, 0) OVER w AS target, lag(token_id, 1, -1) OVER w AS previous FROM tokens WINDOW w AS (PARTITION BY seq_id ORDER BY pos)")
def e15(spark, d):
    t = tokens(spark, d)
    return t.select("seq_id", "pos", T.shift("token_id", 1, 0).alias("target"), T.shift("token_id", -1, -1).alias("previous"))


LOGITS = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS p, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS q FROM embeddings"


def _logits(spark, d):
    e = table(spark, d, "embeddings").withColumn("p", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", "label", "p", F.reverse("p").alias("q"))


@query("J17_log_softmax_entropy", f"WITH l AS ({LOGITS}) SELECT vec_id, round(p[label % 64 + 1] - ln(list_sum(list_transform(p, lambda x: exp(x)))), 6) AS logprob, round(ln(list_sum(list_transform(p, lambda x: exp(x)))) - list_sum(list_transform(p, lambda x: exp(x) * x)) / list_sum(list_transform(p, lambda x: exp(x))), 6) AS entropy FROM l")
def j17(spark, d):
    return _logits(spark, d).select("vec_id", r6(T.log_softmax_at(F.col("p"), F.col("label") % 64)).alias("logprob"), r6(T.entropy(F.col("p"))).alias("entropy"))


@query("J18_reverse_kl", f"WITH l AS ({LOGITS}), z AS (SELECT *, ln(list_sum(list_transform(p, lambda x: exp(x)))) AS zp, ln(list_sum(list_transform(q, lambda x: exp(x)))) AS zq FROM l) SELECT vec_id, round(list_sum([exp(p[i] - zp) * ((p[i] - zp) - (q[i] - zq)) for i in range(1, 65)]), 6) + 0.0 AS kl FROM z")
def j18(spark, d):
    return _logits(spark, d).select("vec_id", r6(T.reverse_kl(F.col("p"), F.col("q"))).alias("kl"))


@query("C11_gather_logprob", "SELECT vec_id, round(embedding[label % 64 + 1]::DOUBLE, 6) + 0.0 AS value FROM embeddings")
def c11(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r6(S.gathered(F.col("embedding"), F.col("label") % 64).cast("double")).alias("value"))


@query("E02_streaks_over_events", "WITH h AS (SELECT user_id, event_id, (value > 50)::INT AS hot, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events), s AS (SELECT *, sum(hot) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM h) SELECT user_id, max(streak)::BIGINT AS longest FROM s GROUP BY user_id")
def e02(spark, d):
    return metrics.longest_streak(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 50)


VALID = """SELECT *, CASE WHEN l_partkey % 97 = 0 THEN 'prompt_mask' WHEN l_partkey % 89 = 0 THEN 'completion_mask' WHEN l_suppkey % 83 = 0 THEN 'logprobs' WHEN l_suppkey % 79 = 0 THEN 'temperatures' WHEN l_quantity = 1 THEN 'empty' WHEN l_quantity + l_partkey % 50 > 90 THEN 'too_long' WHEN l_partkey % 61 = 0 THEN 'teacher' END AS reason FROM lineitem"""


def _valid(spark, d):
    n, p = F.when(F.col("l_quantity") == 1, F.lit(0.0)).otherwise(F.col("l_quantity")), F.col("l_partkey") % 50
    off = lambda c, k: F.when(F.col(c) % k == 0, 1).otherwise(0)
    reason = packing.validate(p, p + off("l_partkey", 97), n, n + off("l_partkey", 89), n + off("l_suppkey", 83), n + off("l_suppkey", 79), F.when(F.col("l_partkey") % 61 == 0, p + n + 1), 90)
    return table(spark, d, "lineitem").withColumn("reason", reason)


@query("B12_sample_validation", f"SELECT reason, count(*) AS n FROM ({VALID}) GROUP BY reason")
def b12(spark, d):
    return _valid(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("B13_samples_before_first_bad", f"WITH v AS ({VALID}), f AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN l_orderkey END) OVER (PARTITION BY l_suppkey) AS first FROM v) SELECT l_suppkey AS run_id, count(*) AS kept FROM f WHERE first IS NULL OR l_orderkey < first GROUP BY l_suppkey")
def b13(spark, d):
    v = _valid(spark, d).select(F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("idx"), "reason")
    return packing.before_first_bad(v, F.col("reason").isNotNull()).groupBy("run_id").agg(F.count("*").alias("kept"))


@query("B16_step_gate", "SELECT client AS run_id, count(*) AS n, sum(completion_len)::BIGINT AS tokens FROM rollouts WHERE version <= client % 7 + 1 GROUP BY client", ("rollouts",))
def b16(spark, d):
    progress = table(spark, d, "supplier").select(F.col("s_suppkey").alias("client"), (F.col("s_suppkey") % 7 + 1).alias("step"))
    due = runs.due_samples(view(spark, d, "rollouts"), progress, "version", "client")
    return due.groupBy(F.col("client").alias("run_id")).agg(F.count("*").alias("n"), F.sum("completion_len").alias("tokens"))
