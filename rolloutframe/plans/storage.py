"""Queries on readers and writers, runs, pools in files, monitors' tables and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import extensions
from ..operators import advantage, datasets, metrics, pools, runs
from ..operators import tokens as T
from ..sources import io
from ..sources.carriers import table, view
from ..sources.shared import new_path
from .data import steps
from .records import CALLS
from .registry import query, r6
from .tokens import GIB, GIB_LIMIT, LOSS, REP, SQL, _arrays, tokens


@query("A01_dataset_scan", "SELECT doc_id, lang AS __subset, 'train' AS __split FROM documents WHERE lang IS NOT NULL")
def a01(spark, d):
    docs, root = table(spark, d, "documents").select("doc_id", "lang"), new_path(spark)
    io.write_subsets(docs, root, "lang")
    return io.read_subsets(spark, root, docs.select("doc_id").schema)


@query("A02_local_dataset", "SELECT p_partkey, p_brand FROM part")
def a02(spark, d):
    root = new_path(spark)
    table(spark, d, "part").select("p_partkey", "p_brand").write.parquet(root)
    io.write_text(spark, f"{root}/dataset_info.json", "{}")
    return io.load_dataset(spark, root, ["ignored"])


@query("A06_seeded_order", "SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || '-42'), p_partkey) - 1 AS place FROM part")
def a06(spark, d):
    return datasets.shuffled(table(spark, d, "part").select("p_partkey"), "p_partkey", 42)


@query("F11_uniform_examples", "WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS c FROM part) SELECT o_orderkey AS draw, p_partkey FROM orders JOIN n ON i = floor(('0x' || substr(md5(o_orderkey || '-5'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE * c)::BIGINT")
def f11(spark, d):
    return datasets.sample_examples(table(spark, d, "orders").select(F.col("o_orderkey").alias("draw")), table(spark, d, "part").select("p_partkey"), ["p_partkey"], 5)


@query("G04_single_dataset", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def g04(spark, d):
    one = table(spark, d, "documents").select("doc_id", F.lit("only").alias("source"))
    return datasets.interleave_all(one, "source", ["doc_id"]).select("doc_id", F.col("position").cast("long").alias("position"))


@query("A31_fake_batches", """WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents), s AS (SELECT place % 3 AS rank, place // 3 // 8 AS batch, place // 3 % 8 AS i FROM r), t AS (SELECT *, rank * 1000000 + batch * 1000 + i AS seed FROM s)
SELECT *, list_sum(list_transform(range(64), lambda k: floor(('0x' || substr(md5(seed || ':' || k || '-0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE * 120000)::BIGINT * (k + 1)))::BIGINT AS placed FROM t""")
def a31(spark, d):
    f = datasets.fake_batches(table(spark, d, "documents"), ["doc_id"], 3, 8, 64)
    placed = F.aggregate(F.transform("input_ids", lambda x, k: x.cast("long") * (k + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return f.select("rank", "batch", "i", "seed", placed.alias("placed"))


POOL = "CASE WHEN p_size >= 40 THEN 'easy' WHEN p_size <= 10 THEN 'hard' END"
EXAMPLE = "p_name string, p_type string, p_partkey string"


def _examples(spark, d):
    p = table(spark, d, "part")
    pool = F.when(F.col("p_size") >= 40, "easy").when(F.col("p_size") <= 10, "hard")
    return p.select(F.col("p_brand").alias("env_name"), F.col("p_partkey").alias("example_id"), "p_name", "p_type", F.col("p_partkey").cast("string").alias("p_partkey"), pool.alias("pool"))


@query("A08_jsonl_sink", f"SELECT p_name, p_type, p_partkey::VARCHAR AS p_partkey FROM part WHERE {POOL} = 'easy'")
def a08(spark, d):
    path = new_path(spark)
    io.save_pools(_examples(spark, d), spark.createDataFrame([], "env_name string"), path)
    return io.read_jsonl(spark, f"{path}/easy_examples", EXAMPLE)


@query("A09_jsonl_pool_restore", f"SELECT p_brand AS env_name, p_partkey AS example_id, {POOL} AS pool FROM part WHERE {POOL} IS NOT NULL")
def a09(spark, d):
    path, e = new_path(spark), _examples(spark, d)
    io.save_pools(e, spark.createDataFrame([], "env_name string"), path)
    return io.load_pools(spark, path, e.drop("pool"), ["p_name", "p_type", "p_partkey"], EXAMPLE, "env_name string")[0]


@query("B22_known_environments", "SELECT o_orderkey, o_orderpriority AS env_name FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def b22(spark, d):
    path = new_path(spark)
    rollouts = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("env_name"))
    io.save_pools(spark.createDataFrame([], "pool string"), rollouts, path)
    known = spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "env_name string")
    return io.known_envs(io.read_jsonl(spark, f"{path}/rollout_buffer", rollouts.schema), known).select("o_orderkey", "env_name")


def _batches(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("run_id"), (F.col("o_orderkey") % 7).alias("step"), F.col("o_orderkey").alias("sample"))


@query("A10_batch_sink", "SELECT o_custkey % 5 AS run_id, o_orderkey % 7 AS step, o_orderkey AS sample FROM orders")
def a10(spark, d):
    path = new_path(spark)
    batches = _batches(spark, d)
    extensions.make_transport("filesystem", spark, path)[0].send(batches)
    b = io.read_batches(spark, path, schema=batches.schema)
    return b.select(F.col("run_id").cast("long").alias("run_id"), F.col("step").cast("long").alias("step"), "sample")


@query("A16_next_batches_once", "SELECT o_custkey % 5 AS run_id, o_orderkey % 7 AS step, o_orderkey AS sample FROM orders WHERE o_orderkey % 7 < 2")
def a16(spark, d):
    path = new_path(spark)
    batches = _batches(spark, d)
    sender, receiver = extensions.make_transport("filesystem", spark, path, schema=batches.schema)
    sender.send(batches)
    b = receiver.receive().unionByName(receiver.receive())  # steps 0, then steps 1
    return b.select(F.col("run_id").cast("long").alias("run_id"), F.col("step").cast("long").alias("step"), "sample")


def _grid(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("step"), (F.col("o_orderkey") % 4).alias("worker"), F.col("o_orderkey").alias("slot"))


@query("A12_micro_batch_sink", "SELECT o_custkey % 3 AS step, o_orderkey % 4 AS worker, count(*) AS n FROM orders GROUP BY ALL")
def a12(spark, d):
    path = new_path(spark)
    grid = _grid(spark, d)
    extensions.TableSender(path, micro=True).send(grid)
    return io.read_dataset(spark, path, schema=grid.schema).groupBy(F.col("step").cast("long").alias("step"), F.col("worker").cast("long").alias("worker")).agg(F.count("*").alias("n"))


@query("A13_micro_batch_source", "SELECT o_orderkey AS slot FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 4 = 2")
def a13(spark, d):
    path = new_path(spark)
    grid = _grid(spark, d)
    io.write_micro_batches(grid, path)
    return io.read_micro_batches(spark, path, 2, 1, grid.schema).select("slot")


@query("A11_next_expected_batches", "SELECT o_custkey % 50 AS run, o_orderkey % 7 AS step, o_orderkey FROM orders WHERE o_orderkey % 7 = (o_custkey % 50) % 4 AND (o_custkey % 50) % 3 <> 0")
def a11(spark, d):
    b = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("run"), (F.col("o_orderkey") % 7).alias("step"), "o_orderkey")
    progress = spark.range(50).select(F.col("id").alias("run"), (F.col("id") % 4).alias("step"), (F.col("id") % 3 == 0).alias("ready"))
    return runs.next_batches(b, progress)


@query("K13_run_lifecycle", "SELECT user_id AS run, CASE arg_max(event_type, event_id) WHEN 'view' THEN 'active' WHEN 'click' THEN 'evicted' ELSE 'deleted' END AS state, max(event_id) AS since FROM events GROUP BY user_id")
def k13(spark, d):
    kind = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "click", "evict").otherwise("delete")
    return runs.lifecycle(table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), kind.alias("kind")))


RUN_LOG = """l AS (SELECT user_id AS run, event_id AS t, CASE event_type WHEN 'view' THEN 'create' WHEN 'signup' THEN 'create' WHEN 'click' THEN 'evict' ELSE 'delete' END AS kind FROM events),
e AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'evict' THEN kind = 'create' END IGNORE NULLS) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM l),
s AS (SELECT run, t, CASE kind WHEN 'create' THEN 'active' WHEN 'evict' THEN 'evicted' ELSE 'deleted' END AS state FROM e WHERE there OR kind = 'create'),
c AS (SELECT *, lag(state) OVER (PARTITION BY run ORDER BY t) AS before FROM s),
v AS (SELECT run, state, t AS valid_from, lead(t) OVER (PARTITION BY run ORDER BY t) AS valid_to FROM c WHERE before IS NULL OR before <> state)"""


def _log(spark, d):
    kind = F.when(F.col("event_type").isin("view", "signup"), "create").when(F.col("event_type") == "click", "evict").otherwise("delete")
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), kind.alias("kind"))


@query("K13_run_history", f"WITH {RUN_LOG} SELECT * FROM v")
def k13_history(spark, d):
    log = _log(spark, d)
    half = log.agg(F.floor(F.avg("at")).alias("half"))  # what came first, and what an upsert adds
    log = log.join(F.broadcast(half))
    return runs.upserted(runs.history(log.where("at <= half").drop("half")), log.where("at > half").drop("half"))


@query("K13_state_at_time", f"""WITH {RUN_LOG}, p AS (SELECT o_orderkey, o_custkey % 200 AS run, o_orderkey % 12000 AS t FROM orders)
SELECT o_orderkey, p.run, p.t AS "at", v.state FROM p ASOF LEFT JOIN v ON p.run = v.run AND p.t >= v.valid_from""")
def k13_as_of(spark, d):
    probes = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("run"), (F.col("o_orderkey") % 12000).alias("at"))
    return runs.state_at(probes, runs.history(_log(spark, d)))


@query("K15_silences", """SELECT user_id, b AS "from", ts AS "to" FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE ts > b + INTERVAL 30 MINUTE""")
def k15(spark, d):
    return runs.silences(table(spark, d, "events"), "user_id", "ts")


@query("K04_async_barrier", "SELECT o_orderkey, o_custkey % 10 - o_orderkey % 8 <= 2 AS may_run FROM orders")
def k04(spark, d):
    return table(spark, d, "orders").select("o_orderkey", runs.may_run(F.col("o_custkey") % 10, F.col("o_orderkey") % 8, 2).alias("may_run"))


@query("K05_requeued_rollouts", """SELECT o_custkey AS "group", sum(o_orderkey % 4 + 1)::BIGINT AS rollouts_to_schedule FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")
def k05(spark, d):
    return runs.requeued(table(spark, d, "orders").select(F.col("o_custkey").alias("group"), (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_orderkey") % 4 + 1).alias("rollouts")))


@query("K16_stale_broadcasts", "SELECT o_orderkey, o_custkey % 5 = o_orderkey % 5 AND o_custkey % 9 > o_orderkey % 5 AS stale FROM orders")
def k16(spark, d):
    return table(spark, d, "orders").select("o_orderkey", runs.stale_broadcast(F.col("o_custkey") % 5, F.col("o_orderkey") % 5, F.col("o_custkey") % 9).alias("stale"))


@query("K17_iterator_state", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c FROM documents) SELECT doc_id, (450 // c)::BIGINT AS epoch FROM n WHERE i >= 450 % c")
def k17(spark, d):
    n = datasets.with_provenance(table(spark, d, "documents").select("doc_id"), None, "train", ["doc_id"])
    return runs.after_state(n, "__index", 450, n.count()).select("doc_id", "epoch")


@query("A28_weight_dir", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ckpt/' || o_orderkey ELSE 'broadcast/' || o_orderkey END AS path FROM orders")
def a28(spark, d):
    k = F.col("o_orderkey")
    path = runs.weight_dir(F.concat(F.lit("ckpt/"), k), F.col("o_orderstatus") == "F", F.concat(F.lit("broadcast/"), k), F.col("o_orderstatus") == "O", check=False)
    return table(spark, d, "orders").select("o_orderkey", path.alias("path"))


@query("A23_run_gauges", "SELECT c_custkey AS run, max(o_orderkey) AS step, count(o_orderkey) = 0 AS removed FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def a23(spark, d):
    stats = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("run")).agg(F.max("o_orderkey").alias("step"))
    return runs.gauges(stats, table(spark, d, "customer").select(F.col("c_custkey").alias("run"))).select("run", "step", "removed")


@query("C13_ready_servers", "SELECT DISTINCT 'http://10.0.0.' || s_suppkey % 97 || ':8000/v1' AS url FROM supplier WHERE s_nationkey % 3 = 0 AND s_nationkey % 4 <> 1")
def c13(spark, d):
    s = table(spark, d, "supplier")
    servers = s.select(F.col("s_suppkey").alias("position"), F.concat(F.lit("10.0.0."), F.col("s_suppkey") % 97).alias("ip"))
    checks = s.select(F.col("s_suppkey").alias("position"), (F.col("s_nationkey") % 3 == 0).alias("has_model"), F.when(F.col("s_nationkey") % 4 == 1, "timeout").alias("error"))
    return runs.ready_servers(servers, checks, 8000)


@query("C06_metric_columns", "SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def c06(spark, d):
    return metrics.spread(table(spark, d, "events").select("event_id", "event_type", "props"), "props", ["k"]).select("event_id", "event_type", "k")


@query("B27_group_scoring", "SELECT env_name, bool_or(task = 'P') AS grouped FROM rollouts GROUP BY env_name", ("rollouts",))
def b27(spark, d):
    return view(spark, d, "rollouts").groupBy("env_name").agg(F.bool_or(F.col("task") == "P").alias("grouped"))


@query("B28_requested_columns", "SELECT conv_id, turn, role FROM conversations")
def b28(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role")


@query("D25_validation_mean", "SELECT event_type, round(sum(value) FILTER (WHERE event_id % 7 <> 0) / sum(user_id + 1) FILTER (WHERE event_id % 7 <> 0), 6) AS mean, count(*) FILTER (WHERE event_id % 7 = 0) AS nan_count FROM events GROUP BY event_type")
def d25(spark, d):
    loss = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    m = metrics.validation_mean(table(spark, d, "events").select("event_type", loss.alias("loss_sum"), (F.col("user_id") + 1).alias("n_tokens")), keys=("event_type",))
    return m.select("event_type", r6("mean").alias("mean"), "nan_count")


@query("D36_log_z_one_mask", "SELECT example_id, round(avg(reward + 0.3::DOUBLE * (ln(1 + completion_len) - ln(2 + completion_len))), 6) + 0.0 AS log_z FROM rollouts GROUP BY example_id", ("rollouts",))
def d36(spark, d):
    n = F.col("completion_len")
    return metrics.log_z(view(spark, d, "rollouts"), F.col("reward"), F.log(1 + n), F.log(2 + n), 0.3).select("example_id", r6("log_z").alias("log_z"))


@query("F03_merged_top_tokens", LOSS + " SELECT seq_id, pos::INT AS pos, round(kl, 9) + 0.0 AS kl FROM c WHERE mask ORDER BY round(kl, 9) DESC, seq_id, pos LIMIT 20")
def f03(spark, d):
    t = T.loss_columns(tokens(spark, d)).withColumn("mismatch_kl", F.round("mismatch_kl", 9) + F.lit(0.0)).withColumn("rank", F.col("seq_id") % 8)
    return T.merged_top(t.select("seq_id", "pos", "mismatch_kl", "mask", "rank"), 20, "rank").select("seq_id", "pos", F.col("mismatch_kl").alias("kl"))


@query("A18_rollout_digests", """SELECT o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}') AS sha256 FROM orders""")
def a18(spark, d):
    path = new_path(spark)
    io.write_rollouts(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, 3)
    return io.digests(spark.read.parquet(f"{path}/step_3")).select("o_orderkey", "sha256")


@query("A19_sample_table", f"WITH {CALLS} SELECT conv_id AS rollout_id, arg_max(shown + n, turn)::INT AS n, '[' || repeat('null,', count(*) - 1) || 'null]' AS compaction_events FROM a GROUP BY conv_id")
def a19(spark, d):
    return io.sample_table(steps(spark, d)).select("rollout_id", F.size("input_ids").alias("n"), "compaction_events")


@query("A20_eval_sample_table", "SELECT conv_id, turn, 'env' AS env, 4::BIGINT AS step FROM conversations WHERE role = 'assistant' AND length(text) > 0")
def a20(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("completion"))
    return io.eval_sample_table(rows, "env", 4).drop("completion")


@query("A21_final_summary", "SELECT event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY event_type")
def a21(spark, d):
    return io.final_summary(table(spark, d, "events"), "event_type", "value", "event_id").select("event_type", r6("value").alias("value"))


def _records(spark, d):
    p = F.col("p_partkey")
    config = F.struct((p % 4 != 0).alias("success"), F.col("p_type").alias("type"), F.col("p_brand").alias("hardware"), F.col("p_name").alias("model"), p.alias("seq_len"))
    return table(spark, d, "part").select(config.alias("config"), F.struct(F.col("p_retailprice").alias("mfu")).alias("metrics"))


@query("A36_benchmark_sink", "SELECT p_partkey AS seq_len, p_brand AS hardware, p_retailprice AS mfu FROM part")
def a36(spark, d):
    path = new_path(spark)
    io.write_benchmarks(_records(spark, d), path)
    return io.read_benchmarks(spark, path, whole_files=False).select("config.seq_len", "config.hardware", "metrics.mfu")


@query("A35_benchmark_scan", "SELECT p_partkey AS seq_len, true AS nested FROM part")
def a35(spark, d):
    path = new_path(spark)
    # records at several depths, and files that cannot be parsed
    for depth, part in (("", 0), ("/a", 1), ("/a/b", 2)):
        io.write_benchmarks(_records(spark, d).where(F.pmod("config.seq_len", F.lit(3)) == part), f"{path}{depth}/records")
    io.write_text(spark, f"{path}/broken.json", "{not json")
    io.write_text(spark, f"{path}/a/empty.json", "")
    got = io.read_benchmarks(spark, path, whole_files=False).where("config is not null")
    # each record is at the depth that it was written to
    below = F.substring_index(F.regexp_extract(F.input_file_name(), "[^/]+/((a/(b/)?)?records)/", 1), "records", 1)
    return got.select("config.seq_len", (F.regexp_count(below, F.lit("/")) == F.pmod("config.seq_len", F.lit(3))).alias("nested"))


@query("B23_successful_benchmarks", "SELECT p_partkey AS seq_len FROM part WHERE p_partkey % 4 <> 0")
def b23(spark, d):
    return io.successful(_records(spark, d)).select("config.seq_len")


@query("A37_checkpoint", "SELECT 'progress' AS kind, o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY o_custkey UNION ALL SELECT 'buffer', o_orderkey, o_custkey FROM orders")
def a37(spark, d):
    path, o = new_path(spark), table(spark, d, "orders")
    io.save_checkpoint(o.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")), o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v")), path, 9)
    progress, buffer = io.load_checkpoint(spark, path, 9)
    return progress.withColumn("kind", F.lit("progress")).unionByName(buffer.withColumn("kind", F.lit("buffer"))).select("kind", "k", "v")


@query("J28_nested_attributes", "SELECT o_orderkey, o_custkey AS got, o_custkey + 1 AS changed FROM orders")
def j28(spark, d):
    nested = F.struct(F.struct(F.struct(F.col("o_custkey").alias("c")).alias("b")).alias("a"))
    n = table(spark, d, "orders").select("o_orderkey", nested.alias("x"))
    x = extensions.with_attribute(F.col("x"), "a.b.c", extensions.attribute(F.col("x"), "a.b.c") + 1)
    return n.select("o_orderkey", extensions.attribute(F.col("x"), "a.b.c").alias("got"), extensions.attribute(x, "a.b.c").alias("changed"))


FOUND = f"""WITH {SQL}, g AS (SELECT seq_id, min(CASE WHEN token_id > 100000 AND inference < {GIB_LIMIT!r} THEN pos END) AS gibberish FROM tokens GROUP BY seq_id),
h AS (SELECT seq_id, pos, (inference > {REP})::INT AS hot, sum(CASE WHEN inference > {REP} THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY pos) AS island FROM tokens),
s AS (SELECT *, sum(hot) OVER (PARTITION BY seq_id, island ORDER BY pos) AS streak FROM h), r AS (SELECT seq_id, min(CASE WHEN streak >= 4 THEN pos END) AS repetition FROM s GROUP BY seq_id)"""


@query("B03_filters_by_name", FOUND + " SELECT seq_id, gibberish::INT AS gibberish, repetition::INT AS repetition FROM g JOIN r USING (seq_id)")
def b03(spark, d):
    made = [extensions.make_filter(c, GIB[1]) for c in ({"type": "gibberish", "token_id_threshold": GIB[0], "logprob_offset": GIB[2]}, {"type": "repetition", "window": 4, "prob_threshold": 0.01})]
    return _arrays(spark, d).select("seq_id", *[f.check(F.col("ids"), F.col("lp")).cast("int").alias(f.name) for f in made])


@query("L03_filter_protocol", FOUND + " SELECT seq_id, CASE WHEN repetition IS NOT NULL THEN 'repetition' WHEN gibberish IS NOT NULL THEN 'gibberish' END AS stop_condition FROM g JOIN r USING (seq_id)")
def l03(spark, d):
    own = extensions.make_filter({"type": "rolloutframe.extensions:RepetitionFilter", "window": 4, "prob_threshold": 0.01, "enforce": True}, GIB[1])
    other = extensions.make_filter({"type": "gibberish", "token_id_threshold": GIB[0], "logprob_offset": GIB[2], "enforce": True}, GIB[1])
    return extensions.run_filters(_arrays(spark, d), [own, other]).select("seq_id", "stop_condition")


PPO = LOSS + " SELECT seq_id, round(-coalesce(sum(least(exp(de) * advantage, least(greatest(exp(de), 0.95::DOUBLE), 1.05::DOUBLE) * advantage)) FILTER (WHERE mask), 0), 5) + 0.0 AS loss, round(avg((exp(de) < 0.95::DOUBLE OR exp(de) > 1.05::DOUBLE)::INT) FILTER (WHERE mask), 6) AS clip_frac FROM c GROUP BY seq_id"


@query("L02_custom_loss", PPO)
def l02(spark, d):
    out = extensions.custom_loss(tokens(spark, d), "rolloutframe.extensions.ppo_clip", clip_eps=0.05)
    return out.select("seq_id", (F.round("loss", 5) + F.lit(0.0)).alias("loss"), r6("clip_frac").alias("clip_frac"))


@query("L02_custom_array_loss", PPO)
def l02_arrays(spark, d):
    out = extensions.custom_array_loss(tokens(spark, d), "rolloutframe.extensions.ppo_clip_arrays", ["trainer", "inference", "advantage", "mask"], ["loss", "clip_frac"], clip_eps=0.05)
    return out.select("seq_id", (F.round("loss", 5) + F.lit(0.0)).alias("loss"), r6("clip_frac").alias("clip_frac"))


@query("L08_normalized_advantage", "SELECT example_id, rollout_idx, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-8), 5) + 0.0 AS advantage FROM groups4 WINDOW w AS (PARTITION BY example_id)", ("groups4",))
def l08(spark, d):
    f = extensions.import_object("rolloutframe.operators.advantage.normalized")
    return advantage.custom_advantage(view(spark, d, "groups4"), f).select("example_id", "rollout_idx", (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


@query("F06_full_batches", "WITH n AS (SELECT example_id, rollout_idx, row_number() OVER (ORDER BY example_id, rollout_idx) - 1 AS i, count(*) OVER () AS c FROM rollouts) SELECT example_id, rollout_idx, i // 256 AS batch FROM n WHERE i // 256 < c // 256", ("rollouts",))
def f06b(spark, d):
    return runs.full_batches(view(spark, d, "rollouts").select("example_id", "rollout_idx"), ["example_id", "rollout_idx"], 256)
