"""Further queries: validation, joins, ordered computations, samples and layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import datasets, metrics, packing, runs, stacking, trajectory
from ..operators import tokens as T
from ..operators.ordering import numbered
from ..sources.carriers import parts, table, view
from ..sources.shared import written
from .data import steps
from .records import _fair
from .registry import query, r6
from .tokens import LOSS, tokens

WORDS = "len(string_split(text, ' '))"


def _words(spark, d):
    return table(spark, d, "documents").withColumn("n", F.size(F.split("text", " ")))


@query("A33_task_prompts", "SELECT p_type || '_' || p_partkey AS id, 'Task ' || p_type || ': ' || p_name AS prompt FROM part")
def a33(spark, d):
    i, prompt = datasets.task_prompt(F.col("p_type"), F.col("p_partkey"), F.col("p_name"))
    return table(spark, d, "part").select(i.alias("id"), prompt.alias("prompt"))


@query("A03_subset_split_pairs", "SELECT lang AS __subset, 'train' AS __split, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def a03(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    pairs = datasets.subset_pairs(docs.select(F.col("lang").alias("__subset")).distinct())
    return docs.join(pairs, docs["lang"] == pairs["__subset"]).groupBy("__subset", "__split").agg(F.count("*").alias("n"))


@query("B07_prompt_length_filter", f"SELECT doc_id FROM documents WHERE {WORDS} <= 300")
def b07(spark, d):
    return _words(spark, d).where(datasets.shorter(F.col("n"), 300)).select("doc_id")


@query("B08_trainable_within_seq_len", "WITH t AS (SELECT conv_id, turn, role, coalesce(sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations) SELECT DISTINCT conv_id FROM t WHERE role = 'assistant' AND start < 64")
def b08(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.size(F.split("text", " ")).alias("n"), "role"))).alias("m"))
    mask = trajectory.incremental_mask(F.col("m.n"), F.col("m.role"))
    return m.where(F.exists(F.slice(mask, 1, 64), lambda x: x)).select("conv_id")


@query("B09_longer_than_seq_len", f"SELECT doc_id FROM documents WHERE {WORDS} > 1024")
def b09(spark, d):
    return _words(spark, d).where(~datasets.shorter(F.col("n"), 1024)).select("doc_id")


@query("B20_malformed_payloads", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL")
def b20(spark, d):
    return table(spark, d, "events").select("event_id", S.payload_number(F.col("props"), "k").alias("k")).where("k is not null")


@query("B21_rollouts_with_tokens", "SELECT DISTINCT conv_id AS rollout_id FROM conversations WHERE role = 'assistant'")
def b21(spark, d):
    return trajectory.interleave(steps(spark, d)).select("rollout_id").distinct()


@query("C05_zip_rollout_advantage", "SELECT example_id, rollout_idx, round(reward - avg(reward) OVER (PARTITION BY example_id), 6) + 0.0 AS advantage, completion_len FROM groups4", ("groups4",))
def c05(spark, d):
    g = view(spark, d, "groups4")
    key = ["example_id", "rollout_idx"]
    a = g.select(*key, (F.col("reward") - F.avg("reward").over(Window.partitionBy("example_id"))).alias("advantage"))
    n = parts(spark, table(spark, d, "lineitem"))  # the join is by both keys, so both sides are dealt once more
    return g.select(*key, "completion_len").repartition(n, *key).join(a.repartition(n, *key), key).select(*key, r6("advantage").alias("advantage"), "completion_len")


@query("C07_prefix_pairs", "WITH s AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations) SELECT a.conv_id, a.turn AS prefix, b.turn AS step FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn > a.turn AND length(b.t) > length(a.t) AND starts_with(b.t, a.t)")
def c07(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = table(spark, d, "conversations").select("conv_id", "turn", F.flatten(F.collect_list(F.split("text", " ")).over(w)).alias("ids"))
    return trajectory.prefix_pairs(s, "conv_id", "turn", "ids")


@query("C12_adapter_match", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN true WHEN c_custkey % 4 = 1 THEN false WHEN c_custkey % 4 = 2 THEN c_nationkey = c_custkey % 25 ELSE c_mktsegment = 'BUILDING' END AS loaded FROM customer")
def c12(spark, d):
    k = F.col("c_custkey") % 4
    path, name = F.when((k == 1) | (k == 2), F.col("c_nationkey").cast("string")), F.when(k == 3, F.col("c_mktsegment"))
    there = F.when(k != 1, (F.col("c_custkey") % 25).cast("string"))
    return table(spark, d, "customer").select("c_custkey", runs.adapter_matches(path, name, there, F.when(k != 1, F.lit("BUILDING"))).alias("loaded"))


@query("C14_samples_by_run", "SELECT client AS run_id, count(*) AS samples, sum(completion_len + prompt_len)::BIGINT AS tokens FROM rollouts GROUP BY client", ("rollouts",))
def c14(spark, d):
    return runs.sample_totals(view(spark, d, "rollouts").withColumnRenamed("client", "run_id"), F.col("completion_len") + F.col("prompt_len"), "run_id")


@query("D22_loss_scale", "SELECT lang, greatest(sum(n_chars) FILTER (WHERE n_chars > 100), 1)::BIGINT AS loss_scale FROM documents GROUP BY lang")
def d22(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(metrics.loss_scale(F.col("n_chars"), F.col("n_chars") > 100).alias("loss_scale"))


@query("D32_eviction_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS events, coalesce(sum(floor(value)) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS tokens_evicted FROM events GROUP BY user_id")
def d32(spark, d):
    n, evicted = metrics.eviction_counts(F.when(F.col("event_type") == "click", F.coalesce(F.floor("value"), F.lit(0))))
    return table(spark, d, "events").groupBy("user_id").agg(n.alias("events"), evicted.alias("tokens_evicted"))


@query("D35_log_z", "SELECT example_id, round(avg(reward + 0.1::DOUBLE * (ln(1 + completion_len) - ln(1 + prompt_len))), 6) + 0.0 AS log_z FROM rollouts GROUP BY example_id", ("rollouts",))
def d35(spark, d):
    z = metrics.log_z(view(spark, d, "rollouts"), F.col("reward"), F.log(1 + F.col("completion_len")), F.log(1 + F.col("prompt_len")), 0.1)
    return z.select("example_id", r6("log_z").alias("log_z"))


@query("D46_pad_ratio", f"WITH n AS (SELECT lang, {WORDS} AS n, max({WORDS}) OVER (PARTITION BY lang) AS m FROM documents) SELECT lang, round(sum(n)::DOUBLE / sum(m), 6) AS useful, round(1 - sum(n)::DOUBLE / sum(m), 6) AS padded FROM n GROUP BY lang")
def d46(spark, d):
    useful, padded = metrics.pad_ratio("n")
    return _words(spark, d).groupBy("lang").agg(r6(useful).alias("useful"), r6(padded).alias("padded"))


@query("D47_call_mismatch", LOSS + " SELECT seq_id, count(*) AS n, round(avg(kl), 6) + 0.0 AS mean_kl, round(max(kl), 6) + 0.0 AS max_kl, round(avg(abs(de)), 6) + 0.0 AS mean_abs, min(CASE WHEN round(kl, 9) = m THEN pos END)::INT AS worst FROM (SELECT *, max(round(kl, 9)) OVER (PARTITION BY seq_id) AS m FROM c) GROUP BY seq_id")
def d47(spark, d):
    t = T.loss_columns(tokens(spark, d)).withColumn("k", F.round("mismatch_kl", 9))
    return t.groupBy("seq_id").agg(F.count("*").alias("n"), r6(F.avg("mismatch_kl")).alias("mean_kl"), r6(F.max("mismatch_kl")).alias("max_kl"), r6(F.avg(F.abs("delta"))).alias("mean_abs"), F.max_by("pos", F.struct("k", -F.col("pos"))).alias("worst"))


@query("D48_max_over_ranks", f"SELECT doc_id % 50 AS idx, max({WORDS})::INT AS length, bool_and({WORDS} < 2000) AS stackable FROM documents GROUP BY idx")
def d48(spark, d):
    return metrics.over_ranks(_words(spark, d).withColumn("idx", F.col("doc_id") % 50), "idx", "n", F.col("n") < 2000)


@query("E03_first_detection", "SELECT user_id, min(event_id) FILTER (WHERE value > 90) AS index FROM events GROUP BY user_id")
def e03(spark, d):
    return metrics.first_detection(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 90)


@query("E06_split_packed_values", "WITH b AS (SELECT user_id, event_id, value, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS chunk FROM events) SELECT user_id, chunk::BIGINT AS chunk, count(*) AS n, round(arg_min(value, event_id), 6) AS first, round(arg_max(value, event_id), 6) AS last FROM b GROUP BY user_id, chunk")
def e06(spark, d):
    g = datasets.split_packed(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "view", "value")
    return g.select("user_id", "chunk", F.size("values").cast("long").alias("n"), r6(F.get("values", F.lit(0))).alias("first"), r6(F.element_at("values", -1)).alias("last"))


@query("E07_eviction_offset", "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS offset FROM conversations")
def e07(spark, d):
    c = table(spark, d, "conversations")
    evicted = F.when(F.col("role") == "user", F.length("text")).otherwise(0)
    return c.select("conv_id", "turn", datasets.prefix_offset(c, ["conv_id"], ["turn"], evicted, inclusive=True).alias("offset"))


@query("E12_async_retention", "SELECT o_orderkey AS step, greatest(o_orderkey - 3, 0) AS candidate, greatest(o_orderkey - 3, 0) % 5 = 0 AS kept FROM orders")
def e12(spark, d):
    c = S.inference_step(F.col("o_orderkey"), 3)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), c.alias("candidate"), (c % 5 == 0).alias("kept"))


@query("F01_packing_sort", f"SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 2, {WORDS} DESC, doc_id) AS place FROM documents")
def f01(spark, d):
    n = _words(spark, d).select("doc_id", "lang", "n", (F.col("doc_id") % 2).alias("lora_idx"))
    return numbered(n, ["lora_idx", F.desc("n"), "doc_id"], "place", ("lang",)).select("doc_id", (F.col("place") + 1).alias("place"))


@query("F04_first_over_threshold", "SELECT event_id, round(value, 6) AS value FROM events WHERE value >= 95 ORDER BY CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END NULLS LAST, event_id LIMIT 1")
def f04(spark, d):
    call = F.when(F.col("event_id") % 3 != 0, F.col("user_id"))
    return metrics.first_over(table(spark, d, "events"), "value", 95, call, "event_id").select("event_id", r6("value").alias("value"))


@query("F17_fair_selection", _fair(65_536, 0, "", "SELECT run, samples AS n FROM t", "'run_' || client"), ("rollouts",))
def f17(spark, d):
    n = F.col("completion_len") + F.col("prompt_len")
    queue = view(spark, d, "rollouts").select(F.concat(F.lit("run_"), F.col("client")).alias("run"), F.lit(0).cast("long").alias("step"), "example_id", "rollout_idx", n.alias("n_tokens"))
    queue = written(queue)
    progress = queue.select("run").distinct().withColumn("step", F.lit(0).cast("long"))
    return packing.select_fair(queue, progress, 65_536, ["example_id", "rollout_idx"]).groupBy("run").agg(F.count("*").alias("n"))


@query("G05_run_set_difference", "SELECT s_nationkey AS run FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def g05(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run")).distinct(), table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("run"))
    return runs.discovered(s, c)


@query("G06_union_of_keys", "SELECT n_name AS key FROM nation UNION SELECT r_name FROM region")
def g06(spark, d):
    return datasets.key_union(table(spark, d, "nation").select(F.col("n_name").alias("key")), table(spark, d, "region").select("r_name"))


@query("G07_regular_and_summary", "SELECT kind, count(*) AS n FROM (SELECT 'regular' AS kind FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'summary' FROM conversations WHERE role = 'system') GROUP BY kind")
def g07(spark, d):
    c = table(spark, d, "conversations")
    both = datasets.labelled_union(regular=c.where("role = 'assistant'").select("conv_id"), summary=c.where("role = 'system'").select("conv_id"))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("G10_ordered_concat", "SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS place FROM documents")
def g10(spark, d):
    rank = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return datasets.ordered_concat(table(spark, d, "documents"), rank, ["doc_id"]).select("doc_id", (F.col("place") + 1).alias("place"))


@query("H02_split_by_common_prefix", "SELECT conv_id, sum(len(string_split(text, ' '))) FILTER (WHERE turn = 0)::BIGINT AS prompt, sum(len(string_split(text, ' '))) FILTER (WHERE turn > 0)::BIGINT AS completion FROM conversations GROUP BY conv_id")
def h02(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.split("text", " ").alias("w")))).alias("m"))
    c = c.withColumn("full", F.flatten("m.w")).withColumn("p", F.get("m.w", F.lit(0)))
    n = trajectory.common_prefix(F.col("p"), F.col("full"))
    return c.select("conv_id", n.cast("long").alias("prompt"), F.when(F.size("full") > n, F.size("full") - n).cast("long").alias("completion"))


@query("H05_errored_rollouts_train_nothing", "SELECT DISTINCT conv_id AS rollout_id, conv_id % 11 <> 0 AS trains FROM conversations WHERE role = 'assistant'")
def h05(spark, d):
    s = trajectory.interleave(steps(spark, d))
    return s.groupBy("rollout_id").agg(F.bool_or(F.exists("completion_mask", lambda x: x)).alias("trains"))


@query("H11_routed_expert_padding", "WITH p AS (SELECT vec_id, embedding || list_transform(range(80 - len(embedding)), lambda i: -1::FLOAT) AS p FROM embeddings) SELECT vec_id, len(p)::INT AS n, round(list_sum(list_transform(p, lambda x, i: x::DOUBLE * i)), 4) AS placed FROM p")
def h11(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", trajectory.pad_rows(F.col("embedding"), F.lit(80), F.lit(-1.0).cast("float")).alias("p"))
    placed = F.aggregate(F.transform("p", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", F.size("p").alias("n"), F.round(placed, 4).alias("placed"))


@query("H12_advantage_to_samples", "SELECT conv_id AS rollout_id, count(*) AS samples, round(sum(conv_id / 7.0::DOUBLE), 6) AS advantage FROM (SELECT conv_id FROM conversations WHERE role = 'assistant' AND conv_id % 5 = 0 AND turn >= 5 UNION ALL SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND NOT (conv_id % 5 = 0 AND turn >= 5)) GROUP BY conv_id")
def h12(spark, d):
    s = trajectory.interleave(steps(spark, d))
    a = table(spark, d, "conversations").select(F.col("conv_id").alias("rollout_id"), (F.col("conv_id") / F.lit(7.0)).alias("advantage")).distinct()
    return s.join(a, "rollout_id").groupBy("rollout_id").agg(F.count("*").alias("samples"), r6(F.sum("advantage")).alias("advantage"))


@query("I05_dummy_bins", "SELECT lang, (8 - count(*) % 8) % 8 AS dummies FROM documents GROUP BY lang")
def i05(spark, d):
    laid = packing.distribute(table(spark, d, "documents").select(F.col("doc_id").alias("bin"), "lang"), 8, keys=("lang",))
    return laid.groupBy("lang").agg(F.count_if("is_dummy").alias("dummies"))


STACKS = f"(SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS grp, {WORDS} AS n FROM documents)"


@query("I11_vertical_stack", f"SELECT grp, count(*) AS rows, max(n)::INT AS width, (count(*) * max(n))::BIGINT AS area FROM {STACKS} GROUP BY grp")
def i11(spark, d):
    rows = stacking.batched(_words(spark, d).select("doc_id", F.split("text", " ").alias("ids")), ["doc_id"], 64, "grp")
    s = stacking.vertical_stack(rows, ["grp"], "doc_id", {"ids": ""})
    width = F.size(F.get("ids", F.lit(0)))
    return s.select("grp", F.size("ids").cast("long").alias("rows"), width.alias("width"), F.size(F.flatten("ids")).cast("long").alias("area"))


@query("I13_horizontal_pack", f"SELECT doc_id, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n::INT AS length FROM {STACKS}")
def i13(spark, d):
    rows = stacking.batched(_words(spark, d).select("doc_id", F.split("text", " ").alias("ids"), F.array("doc_id").alias("doc")), ["doc_id"], 64, "grp")
    p = stacking.horizontal_pack(rows, ["grp"], "doc_id", ["ids", "doc"])
    return p.select(F.explode(F.arrays_zip("doc", "sequence_offsets", "sequence_lengths")).alias("x")).select(F.col("x.doc").alias("doc_id"), F.col("x.sequence_offsets").cast("long").alias("start"), F.col("x.sequence_lengths").alias("length"))


@query("I17_pad_or_drop", f"SELECT doc_id, 512 AS n, md5(text || repeat(' <pad>', (512 - {WORDS})::INT)) AS digest FROM documents WHERE {WORDS} <= 512")
def i17(spark, d):
    w = _words(spark, d).where(datasets.shorter(F.col("n"), 512)).select("doc_id", packing.padded_to(F.split("text", " "), 512, F.lit("<pad>")).alias("ids"))
    return w.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join("ids", " ")).alias("digest"))


@query("J12_privileged_prompt", "SELECT o_orderkey, 'Q: ' || o_orderpriority || ' A: ' || o_orderstatus AS text FROM orders")
def j12(spark, d):
    both = datasets.dual_prompts(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", "Q: {prompt} A: {ground_truth}")
    return both.where("privileged").select("o_orderkey", "text")


@query("J14_json_or_empty", """SELECT p_partkey, CASE WHEN p_size > 25 THEN '{"size":' || p_size || '}' ELSE '' END AS info FROM part""")
def j14(spark, d):
    return table(spark, d, "part").select("p_partkey", S.json_or_empty(F.when(F.col("p_size") > 25, F.struct(F.col("p_size").alias("size")))).alias("info"))


@query("J15_hardware_labels", "SELECT s_suppkey, (s_suppkey % 8 + 1) || 'x' || split_part(s_name, '#', 1) AS label FROM supplier")
def j15(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.hardware_label(F.col("s_suppkey") % 8 + 1, F.split_part("s_name", F.lit("#"), F.lit(1))).alias("label"))


@query("J21_peak_flops", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 989e12 WHEN 1 THEN 2250e12 WHEN 2 THEN 312e12 ELSE 154.8e12 END::DOUBLE AS peak FROM part")
def j21(spark, d):
    k = F.col("p_partkey") % 4
    device = F.when(k == 0, "NVIDIA H200").when(k == 1, "NVIDIA B200").when(k == 2, "other").otherwise("RTX A6000")
    return table(spark, d, "part").select("p_partkey", S.peak_flops(device).alias("peak"))


@query("J23_sampling_args", """SELECT p_partkey, '{' || CASE WHEN p_size % 2 = 0 THEN '"temperature":' || p_size ELSE '' END || '}' AS args FROM part""")
def j23(spark, d):
    return table(spark, d, "part").select("p_partkey", S.sampling_args(temperature=F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("args"))


@query("J25_seeds", "SELECT o_orderkey, 42 + o_custkey * 1000000 AS seed, o_custkey * 64 + o_orderkey AS batch_seed FROM orders")
def j25(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.step_seed(42, F.col("o_custkey")).alias("seed"), S.batch_seed(F.col("o_custkey"), 64, F.col("o_orderkey")).alias("batch_seed"))


@query("J27_rows_to_columns", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def j27(spark, d):
    names = ["o_orderkey", "o_totalprice"]
    back = datasets.to_rows(datasets.to_columns(table(spark, d, "orders"), "o_custkey", names), "o_custkey", names)
    return back.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
