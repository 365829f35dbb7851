"""Queries on events, calls, messages, images, turns and stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events, messages, packing, stacking, trajectory, turns
from ..sources.carriers import table, view
from ..sources.shared import written
from .data import steps
from .registry import query

WORDS = "len(string_split(text, ' '))"

# what a call sees of the turns before it, in SQL: all their tokens, in every fifth conversation only the last three
CALLS = f"""t AS (SELECT conv_id, turn, role, text, {WORDS} AS n FROM conversations),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
a AS (SELECT *, conv_id % 5 = 0 AND turn >= 5 AS apart, CASE WHEN conv_id % 5 = 0 AND turn >= 5 THEN least(before, 3) ELSE before END AS shown FROM b WHERE role = 'assistant')"""


def _id(word) -> F.Column:
    return (F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("long") % 128000).cast("int")


def _ids(text) -> F.Column:
    return F.transform(F.split(text, " "), _id)


@query("H08_event_coercion", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 2 END AS n, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 97 END AS first_evicted, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 11 END::INT AS first_start,
CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS second_offset, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 13 END AS second_prompt, CASE WHEN o_orderkey % 5 <> 0 THEN -1 END AS last_turn, CASE WHEN o_orderkey % 5 <> 0 THEN 3 END AS kept FROM orders""")
def h08(spark, d):
    k = F.col("o_custkey")
    named = F.format_string('{"num_output_tokens_at_compaction":%d,"tokens_evicted":%d,"position_offset_after":"%d","evict_start":%d,"kept_indices":[1,2,3]}', F.col("o_orderkey") % 7, k % 97, k, k % 11)
    listed = F.format_string("[%d,%d,%d,%d]", F.col("o_orderkey") % 7, k % 97, k, k % 13)
    raw = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("["), named, F.lit(","), listed, F.lit(",[1,2],7]"))).otherwise(F.when(F.col("o_orderkey") % 2 == 0, F.lit("[]")))
    e = table(spark, d, "orders").select("o_orderkey", events.coerce(raw).alias("e"))
    one, two = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    return e.select("o_orderkey", F.when(F.col("e").isNotNull(), F.size("e")).alias("n"), one["tokens_evicted"].cast("long").alias("first_evicted"), one["evict_start"].alias("first_start"), two["position_offset_after"].cast("long").alias("second_offset"), two["num_prompt_tokens"].cast("long").alias("second_prompt"), two["last_turn_evicted"].alias("last_turn"), F.when(one.isNotNull(), F.size(one["kept_indices"])).alias("kept"))


@query("H09_summary_samples", "SELECT o_orderkey AS rollout_id, 3 AS prompt, (o_orderkey % 4)::INT AS completion, CASE WHEN o_custkey % 6 = 0 THEN 0 ELSE o_orderkey % 4 END::INT AS trained, round(-0.5::DOUBLE * (o_orderkey % 4), 6) AS logprob FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 3")
def h09(spark, d):
    n = (F.col("o_orderkey") % 4).cast("int")
    lists = F.format_string('"prompt_token_ids":[%d,1,2],"completion_token_ids":%s,"completion_logprobs":%s', F.col("o_custkey") % 50, F.to_json(F.array_repeat(F.col("o_custkey") % 100, n)), F.to_json(F.array_repeat(F.lit(-0.5), F.when(F.col("o_orderkey") % 9 == 0, n + 1).otherwise(n))))
    extras = F.when(F.col("o_orderkey") % 10 != 3, F.concat(F.lit('{"summary_trainsample":{'), lists, F.lit("}}"))).otherwise(F.lit('{"other":1}'))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("rollout_id"), F.lit(0).alias("step_idx"), extras.alias("extras"), (F.col("o_custkey") % 6 == 0).alias("error"), F.lit(1.0).alias("temperature"))
    s = events.summary_samples(rows)
    return s.select("rollout_id", F.size("prompt_ids").alias("prompt"), F.size("completion_ids").alias("completion"), F.size(F.filter("completion_mask", lambda x: x)).alias("trained"), F.aggregate("completion_logprobs", F.lit(0.0), lambda a, x: a + x).alias("logprob"))


def _calls(spark, d) -> DataFrame:
    rollouts = steps(spark, d)
    return events.call_records(trajectory.interleave(rollouts), rollouts)


@query("H10_call_records", f"WITH {CALLS} SELECT conv_id AS rollout_id, (max((NOT apart)::INT) + count(*) FILTER (WHERE apart))::BIGINT AS samples, count(*) AS calls, sum(n)::BIGINT AS completion_tokens, sum(shown)::BIGINT AS submitted_tokens FROM a GROUP BY conv_id")
def h10(spark, d):
    total = lambda name: F.aggregate("calls", F.lit(0).cast("long"), lambda s, c: s + F.size(c[name]))
    return _calls(spark, d).groupBy("rollout_id").agg(F.count("*").alias("samples"), F.sum(F.size("calls")).alias("calls"), F.sum(total("completion_ids")).alias("completion_tokens"), F.sum(total("submitted_prompt_ids")).alias("submitted_tokens"))


@query("H23_trim_last_call", f"WITH {CALLS}, g AS (SELECT conv_id, apart, CASE WHEN apart THEN turn ELSE -1 END AS sample, sum(n) AS n, arg_max(n, turn) AS last FROM a GROUP BY ALL) SELECT conv_id AS rollout_id, sum(n - least(last, conv_id % 7))::BIGINT AS completion_tokens FROM g GROUP BY conv_id")
def h23(spark, d):
    c = _calls(spark, d).withColumn("calls", events.trim_last_call(F.col("calls"), (F.col("rollout_id") % 7).cast("int")))
    return c.groupBy("rollout_id").agg(F.sum(F.aggregate("calls", F.lit(0).cast("long"), lambda s, x: s + F.size(x["completion_ids"]))).alias("completion_tokens"))


@query("H22_completion_delta", f"WITH {CALLS} SELECT conv_id AS rollout_id, turn::INT AS step_idx, n::INT AS delta FROM a")
def h22(spark, d):
    s = steps(spark, d).select("rollout_id", F.explode("steps").alias("s"))
    delta = events.completion_delta(F.col("s.prompt_ids"), F.concat("s.prompt_ids", "s.completion_ids"))
    return s.select("rollout_id", "s.step_idx", F.size(delta).alias("delta"))


@query("H04_merge_rule", f"WITH {CALLS}, g AS (SELECT conv_id, CASE WHEN apart THEN turn ELSE -1 END AS sample, min(shown) AS prompt, max(shown + n) AS total, sum(n) AS trained FROM a GROUP BY ALL) SELECT conv_id AS rollout_id, sum(total - prompt - trained)::BIGINT AS appended, sum(total - prompt)::BIGINT AS completion, 0.0::DOUBLE AS appended_logprob FROM g GROUP BY conv_id")
def h04(spark, d):
    s = trajectory.interleave(steps(spark, d).withColumn("error", F.lit(False)))
    tail = F.filter(F.arrays_zip("completion_mask", "completion_logprobs", "completion_temperatures"), lambda x: ~x["completion_mask"])
    return s.groupBy("rollout_id").agg(F.sum(F.size(tail)).alias("appended"), F.sum(F.size(F.filter("completion_temperatures", lambda x: x == 1.0))).alias("completion"), F.sum(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x["completion_logprobs"])).alias("appended_logprob"))


@query("H06_midgen_starts_a_sample", f"WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, apart ORDER BY turn) AS i FROM a) SELECT conv_id AS rollout_id, count(*) FILTER (WHERE apart OR i = 1 OR turn % 4 = 3) AS samples FROM r GROUP BY conv_id")
def h06(spark, d):
    marked = F.transform("steps", lambda s: s.withField("midgen", s["step_idx"] % 4 == 3))
    return trajectory.interleave(steps(spark, d).withColumn("steps", marked)).groupBy("rollout_id").agg(F.count("*").alias("samples"))


@query("I02_clamped_events", "WITH e AS (SELECT o_orderkey, len(list_filter(range(1, 6), lambda i: (o_custkey % 7) * i <= o_orderkey % 13)) AS n FROM orders) SELECT o_orderkey, CASE WHEN n > 0 THEN n END::INT AS n FROM e")
def i02(spark, d):
    e = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(((F.col("o_custkey") % 7) * i).alias("num_output_tokens_at_compaction")))
    c = events.clamp(e, F.col("o_orderkey") % 13)
    return table(spark, d, "orders").select("o_orderkey", F.when(c.isNotNull(), F.size(c)).alias("n"))


def _micro_batches(spark, d) -> DataFrame:
    """Parts as micro-batches with some side information."""
    event = F.array(F.struct((F.col("p_size") % 3).alias("num_output_tokens_at_compaction")))
    call = F.array(F.struct(F.when(F.col("p_partkey") % 2 == 0, event).alias("compaction_events")))
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 45, F.lit(b"x")).alias("images"), F.lit(None).cast("array<int>").alias("routed"), F.when(F.col("p_size") < 5, event).alias("events"), F.when(F.col("p_partkey") % 11 == 0, 7).alias("prompt_len"), F.when(F.col("p_partkey") % 3 == 0, call).alias("calls"))


@query("B25_stackable", "SELECT p_partkey, p_size <= 45 AND p_size >= 5 AND p_partkey % 11 <> 0 AND p_partkey % 3 <> 0 AS standard, p_size <= 45 AND p_partkey % 3 = 0 AND NOT (p_partkey % 2 = 0 AND p_size % 3 > 0) AS flex, false AS standard_cp FROM part")
def b25(spark, d):
    c = [F.col(n) for n in ("images", "routed", "events", "prompt_len", "calls")]
    standard = lambda **mode: events.standard_stackable(*c, compaction=False, lora=False, multi_run=False, **mode)
    flex = events.flex_stackable(c[0], c[1], c[4], compaction=True, flex=True)
    return _micro_batches(spark, d).select("p_partkey", standard(cp=False).alias("standard"), flex.alias("flex"), standard(cp=True).alias("standard_cp"))


@query("B26_midgen_calls", "SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND p_size % 3 > 0 AS midgen FROM part")
def b26(spark, d):
    return _micro_batches(spark, d).select("p_partkey", events.calls_inside_generation(F.col("calls")).alias("midgen"))


@query("J01_message_containers", """SELECT o_orderkey, [0, 1, 1, 2][o_orderkey % 4 + 1]::INT AS n, ['', 'user', 'tool', 'user,assistant'][o_orderkey % 4 + 1] AS roles, ['', 'text ' || o_custkey, 'c', 'a,b'][o_orderkey % 4 + 1] AS contents FROM orders""")
def j01(spark, d):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 1, F.format_string('"text %d"', "o_custkey")).when(k == 2, F.lit('{"role":"tool","content":"c"}')).when(k == 3, F.lit('["a",{"role":"assistant","content":"b"}]'))
    m = table(spark, d, "orders").select("o_orderkey", messages.normalize(raw, "user").alias("m"))
    return m.select("o_orderkey", F.size("m").alias("n"), F.array_join("m.role", ",").alias("roles"), F.array_join("m.content", ",").alias("contents"))


@query("J02_tool_arguments", "SELECT o_orderkey, o_custkey AS parsed, o_custkey % 50 AS given FROM orders")
def j02(spark, d):
    calls = F.format_string('[{"function":{"name":"f","arguments":"{\\"k\\": %d}"}},{"function":{"name":"g","arguments":{"k":%d}}}]', "o_custkey", F.col("o_custkey") % 50)
    a = messages.parsed_arguments(calls)
    return table(spark, d, "orders").select("o_orderkey", F.try_variant_get(F.get(a, F.lit(0)), "$.k", "long").alias("parsed"), F.try_variant_get(F.get(a, F.lit(1)), "$.k", "long").alias("given"))


@query("J05_tool_format", """SELECT p_partkey, '{"type":"function","function":{"name":"' || p_name || '","description":' || CASE WHEN p_size > 40 THEN 'null' ELSE '"' || p_type || '"' END || ',"parameters":"' || p_brand || '"' || CASE WHEN p_size % 2 = 0 THEN ',"strict":true' ELSE '' END || '}}' AS tool FROM part""")
def j05(spark, d):
    return table(spark, d, "part").select("p_partkey", messages.function_format(F.col("p_name"), F.when(F.col("p_size") <= 40, F.col("p_type")), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.lit(True))).alias("tool"))


@query("J07_hash_mod")
def j07(spark, d):
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", S.blake2b_mod(F.concat(F.lit("trace_id="), F.col("conv_id"), F.lit("\0")), F.lit(5)).alias("policy"))


@query("H01_filled_tokens", """WITH m AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) AS text, turn = max(turn) OVER (PARTITION BY conv_id) AND role = 'assistant' AS done FROM conversations),
r AS (SELECT conv_id, bool_or(done) AS done, coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (WHERE NOT done), '') AS p, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS f FROM m GROUP BY conv_id),
n AS (SELECT conv_id, done, string_split(p || CASE WHEN done THEN '<|im_start|>assistant' || chr(10) ELSE '' END, ' ') AS p, string_split(f, ' ') AS f FROM r)
SELECT conv_id, (len(p) - done::INT)::INT AS prompt, (len(f) - len(p) + done::INT)::INT AS completion FROM n""")
def h01(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    # the answers of the last turn are the completion; words of one id are still two words
    answer = lambda x: F.coalesce((x["turn"] == F.element_at("m", -1)["turn"]) & (x["role"] == "assistant"), F.lit(False))
    tokens = messages.fill_tokens(F.filter("m", lambda x: ~answer(x)), F.filter("m", answer), lambda text: F.split(text, " "), _id)
    return c.select("conv_id", tokens.alias("t")).select("conv_id", F.size("t.prompt_ids").alias("prompt"), F.size("t.completion_ids").alias("completion"))


def _images(spark, d):
    uses = table(spark, d, "part").select(F.col("p_brand").alias("step"), F.col("p_partkey").alias("position"), F.concat("p_type", F.lit(" "), "p_size").alias("image"))
    return messages.image_indices(uses, ["position"])


@query("H14_image_indices", "WITH g AS (SELECT p_type || ' ' || p_size AS image, min(p_partkey) AS p FROM part GROUP BY 1), i AS (SELECT image, row_number() OVER (ORDER BY p, image) - 1 AS index FROM g) SELECT p_partkey AS position, index FROM part JOIN i ON i.image = p_type || ' ' || p_size")
def h14(spark, d):
    return _images(spark, d)[1].select("position", "index")


@query("H15_assembled_images", "SELECT p_brand AS step, count(*)::INT AS n, sha256(string_agg('<' || p_type || ' ' || p_size || '>', '' ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand")
def h15(spark, d):
    images, uses = _images(spark, d)
    a = messages.assemble(uses, images.withColumn("data", F.concat(F.lit("<"), "image", F.lit(">"))), ["step"], "position", "data")
    return a.select("step", F.size("indices").alias("n"), F.sha2("data", 256).alias("digest"))


@query("H16_images_of_the_last_step", f"WITH {CALLS}, g AS (SELECT conv_id, CASE WHEN apart THEN turn ELSE -1 END AS sample, max(turn) AS step_idx, arg_max(text, turn) AS text FROM a GROUP BY ALL) SELECT conv_id AS rollout_id, step_idx::INT AS step_idx, md5(text) AS data FROM g")
def h16(spark, d):
    s = trajectory.interleave(steps(spark, d)).select("rollout_id", "sample_idx", "step_ids")
    held = table(spark, d, "conversations").select(F.col("conv_id").alias("rollout_id"), F.col("turn").cast("int").alias("step_idx"), F.md5("text").alias("data"))
    return messages.attach_to_last_step(s, held).select("rollout_id", "step_idx", "data")


@query("H17_stripped_images", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'https://x/' || p_size ELSE '[preprocessed image]' END AS url, p_name AS text FROM part")
def h17(spark, d):
    k = F.col("p_partkey") % 3
    url = F.when(k == 0, F.lit("data:image/png;base64,AA")).when(k == 1, F.lit("file:///a.png")).otherwise(F.concat(F.lit("https://x/"), F.col("p_size")))
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("p_name").alias("text"), F.lit(None).cast("string").alias("url")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), url.alias("url")))
    c = table(spark, d, "part").select("p_partkey", messages.strip_images(content).alias("c"))
    return c.select("p_partkey", F.get("c.url", F.lit(1)).alias("url"), F.get("c.text", F.lit(0)).alias("text"))


END = 7


def _turns(spark, d) -> DataFrame:
    """Conversations as turns: what stands in front of each answer, and the answer; every message ends with END, which is
    the token of no word."""
    words = F.transform(_ids(F.coalesce("text", F.lit(""))), lambda x: F.when(x >= END, x + 1).otherwise(x))
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(words, F.array(F.lit(END))).alias("ids"))
    c = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "ids"))).alias("m"))
    answers = F.filter(F.transform("m", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    begin = lambda a, k: F.when(k == 0, F.lit(0)).otherwise(F.get(a, k - 1) + 1)
    c = c.withColumn("a", answers)
    turn = F.transform("a", lambda i, k: F.struct(F.flatten(F.transform(F.slice("m", begin(F.col("a"), k) + 1, i - begin(F.col("a"), k)), lambda x: x["ids"])).alias("user_ids"), F.get("m", i)["ids"].alias("completion_ids"), F.lit(True).alias("trainable")))
    return c.select("conv_id", turn.alias("turns")).where((F.size("turns") > 0) & (F.size(F.get("turns.user_ids", F.lit(0))) > 0))


@query("H20_turn_eviction", """WITH m AS (SELECT conv_id, turn, role = 'assistant' AS answer, len(string_split(coalesce(text, ''), ' ')) + 1 AS n, ceil((len(string_split(coalesce(text, ''), ' ')) + 1) / 16.0)::BIGINT * 16 AS whole FROM conversations),
g AS (SELECT *, coalesce(sum(answer::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM m),
t AS (SELECT conv_id, k, coalesce(sum(whole) FILTER (WHERE NOT answer), 0) AS f, max(n) FILTER (WHERE answer) AS a, min_by(whole, turn) AS first FROM g GROUP BY conv_id, k HAVING bool_or(answer)),
l AS (SELECT *, f + a + (16 - (f + a) % 16) % 16 AS size, count(*) OVER (PARTITION BY conv_id) AS turns FROM t)
SELECT conv_id, sum(size)::INT AS tokens, sum(a)::INT AS trained, count(*)::INT AS calls, greatest(count(*) - 2, 0)::INT AS events, coalesce(sum(size - CASE WHEN k = 0 THEN first ELSE 0 END) FILTER (WHERE k + 2 < turns), 0)::INT AS evicted
FROM l GROUP BY conv_id HAVING max(f) FILTER (WHERE k = 0) > 0""")
def h20(spark, d):
    e = turns.turn_eviction(_turns(spark, d), 2, 1, 16, END)
    return e.select("conv_id", F.size("ids").alias("tokens"), F.size(F.filter("mask", lambda x: x)).alias("trained"), F.size("calls").alias("calls"), F.size(F.filter("calls", lambda c: c["tokens_evicted"] > 0)).alias("events"), F.aggregate("calls", F.lit(0), lambda s, c: s + c["tokens_evicted"]).alias("evicted"))


@query("H21_filler_padding", f"SELECT conv_id, sum(ceil(({WORDS} + 1) / 16.0) * 16)::INT AS padded, sum({WORDS} + 1)::INT AS tokens FROM conversations GROUP BY conv_id")
def h21(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.transform(F.split("text", " "), lambda w: F.length(w) + 1000), F.array(F.lit(END))).alias("ids"))
    c = c.groupBy("conv_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("turn", "ids")))["ids"]).alias("ids"))
    return c.select("conv_id", F.size(turns.pad_after_end(F.col("ids"), END, 16)).alias("padded"), F.size("ids").alias("tokens"))


GROUPS = """WITH RECURSIVE n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, CASE WHEN l_returnflag = 'N' THEN 'standard' WHEN l_returnflag = 'A' THEN 'flex_compaction' END AS kind, greatest(l_quantity::INT, 1) AS len
  FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
r AS (SELECT l_orderkey, l_linenumber, i, kind, 0 AS grp, 1 AS c, len AS longest, len AS total FROM n WHERE i = 1
  UNION ALL SELECT n.l_orderkey, n.l_linenumber, n.i, n.kind, CASE WHEN {joins} THEN r.grp ELSE r.grp + 1 END, CASE WHEN {joins} THEN r.c + 1 ELSE 1 END, CASE WHEN {joins} THEN greatest(r.longest, n.len) ELSE n.len END, CASE WHEN {joins} THEN r.total + n.len ELSE n.len END
  FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.i = r.i + 1)
SELECT l_orderkey, l_linenumber, grp AS "group" FROM r"""


def _lines(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.max("l_quantity").cast("int").alias("length"))
    return rows.withColumn("kind", F.when(F.col("f") == "N", "standard").when(F.col("f") == "A", "flex_compaction"))


@query("E14_adjacent_groups", GROUPS.format(joins="coalesce(n.kind = r.kind, false) AND r.c < 3 AND (r.c + 1) * greatest(r.longest, n.len) <= 90"))
def e14(spark, d):
    return stacking.adjacent_groups(_lines(spark, d), "l_orderkey", ["l_linenumber"], "kind", "length", 3, 90)


@query("I10_horizontal_groups", GROUPS.format(joins="coalesce(n.kind = r.kind, false) AND r.c < 4 AND CASE WHEN n.kind = 'flex_compaction' THEN r.total + n.len ELSE (r.c + 1) * greatest(r.longest, n.len) END <= 80"))
def i10(spark, d):
    return stacking.adjacent_groups(_lines(spark, d), "l_orderkey", ["l_linenumber"], "kind", "length", 4, 80, horizontal=True)


def _rows(spark, d) -> DataFrame:
    ids = F.transform(F.split("text", " "), F.length)
    rows = table(spark, d, "documents").select("doc_id", ids.alias("input_ids"), F.array("n_chars").alias("calls")).withColumn("loss_mask", F.array_repeat(F.lit(True), F.size("input_ids")))
    return stacking.batched(rows, ["doc_id"], 64, "grp")


STACKS = f"(SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS grp, {WORDS} AS n FROM documents)"


@query("I12_vertical_stack_with_calls", f"SELECT grp, count(*)::INT AS rows, max(n)::INT AS width, string_agg(n::VARCHAR, ',' ORDER BY doc_id) AS lengths, sum(n)::BIGINT AS trained, string_agg(n_chars::VARCHAR, ',' ORDER BY doc_id) AS calls FROM {STACKS} GROUP BY grp")
def i12(spark, d):
    s = stacking.vertical_stack(_rows(spark, d), ["grp"], "doc_id", {"input_ids": 1, "loss_mask": False}, "calls")
    trained = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, m: a + F.size(m) - F.size(F.array_remove(m, F.lit(True))))
    same = F.forall("loss_mask", lambda m: F.size(m) == F.size(F.get("input_ids", F.lit(0))))
    return s.where(same).select("grp", F.size("input_ids").alias("rows"), F.size(F.get("input_ids", F.lit(0))).alias("width"), F.array_join("sequence_lengths", ",").alias("lengths"), trained.alias("trained"), F.array_join(F.flatten("calls"), ",").alias("calls"))


@query("E09_horizontal_offsets", f"WITH o AS (SELECT grp, doc_id, n, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM {STACKS}) SELECT grp, sum(n)::INT AS tokens, string_agg(start::VARCHAR, ',' ORDER BY doc_id) AS starts FROM o GROUP BY grp")
def e09(spark, d):
    p = stacking.horizontal_pack(_rows(spark, d), ["grp"], "doc_id", ["input_ids", "loss_mask"])
    return p.select("grp", F.size("input_ids").alias("tokens"), F.array_join("sequence_offsets", ",").alias("starts"))


@query("I18_collate", f"SELECT grp, count(*)::INT AS rows, max(n)::INT AS width FROM {STACKS} GROUP BY grp")
def i18(spark, d):
    s = stacking.vertical_stack(_rows(spark, d), ["grp"], "doc_id", {"input_ids": 0})
    c = stacking.collate(s.select("grp", F.posexplode("input_ids").alias("slot", "input_ids")), ["grp"], "slot", ["input_ids"])
    return c.select("grp", F.size("input_ids").alias("rows"), F.size(F.get("input_ids", F.lit(0))).alias("width"))


@query("I15_stack_packing")
def i15(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", F.size(F.split("text", " ")).alias("n"))
    return stacking.stack_pack(docs, 8192, "lang", "doc_id", "n")


@query("K09_bucket_timeouts")
def k09(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", F.size(F.split("text", " ")).alias("n"))
    s = stacking.stack_pack(docs, 8192, "lang", "doc_id", "n", timeout=3)
    return s.groupBy("lang", "reason").agg(F.count_distinct("batch").alias("batches"), F.count_if(F.col("doc_id").isNull()).alias("dummies"))


PACKED = "SELECT l_suppkey AS run_id, l_linenumber AS step, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice, l_shipdate) AS sample_id, l_partkey % 2 AS lora_idx, CAST(l_quantity AS INT) AS n_tokens FROM lineitem"


def _places(laid: DataFrame, *keys: str) -> DataFrame:
    """Samples, tokens of each place of a layout, and if only one bin is there."""
    bin = F.col("bin").cast("long") * 2 + F.col("is_dummy").cast("int")
    return laid.groupBy(*keys, "worker", "slot").agg(F.count("sample_id").alias("c"), F.sum("n_tokens").alias("t"), (F.min(bin) == F.max(bin)).alias("one"))


@query("I07_single_run_packer", f"WITH s AS ({PACKED}) SELECT run_id, step, count(*) AS samples, sum(n_tokens)::BIGINT AS tokens, true AS even FROM s GROUP BY run_id, step")
def i07(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    s = spark.sql(PACKED)
    bins = _places(packing.single_pack(s, 128, 4), "run_id", "step")
    # every worker has as many bins, and a bin is in one place
    out = bins.groupBy("run_id", "step").agg(F.sum("c").alias("samples"), F.sum("t").cast("long").alias("tokens"), ((F.count("*") == 4 * (F.max("slot") + 1)) & F.bool_and("one") & (F.max("t") <= 128)).alias("even"))
    return out


def _queue(spark, d) -> tuple[DataFrame, DataFrame]:
    """Rollouts waiting in the queues of their clients, and how far each run is. The queue is written, as a selection reads
    it more than once and the view joins and numbers whole tables."""
    r = written(view(spark, d, "rollouts").select(F.col("client").alias("run"), F.col("version").alias("step"), "example_id", "rollout_idx", (F.col("completion_len") + F.col("prompt_len")).alias("n_tokens")))
    r = r.withColumns({"sample_id": F.col("example_id") * 10 + F.col("rollout_idx"), "lora_idx": F.lit(0)})
    zero = F.lit(0).cast("long")
    return r, r.groupBy("run").agg((F.min("step") + F.col("run") % 2).alias("step")).withColumns({"total_samples": zero, "total_tokens": zero})


def _fair(budget: int, start: int, due: str, columns: str, run: str = "client", order: str = "client") -> str:
    """SQL of a fair selection over the rollouts: ``due``, an expression of the first step and the run."""
    return f"""WITH q AS (SELECT {run} AS run, {order} AS ring, {'0' if not due else 'version'} AS step, example_id, rollout_idx, completion_len + prompt_len AS n FROM rollouts),
p AS (SELECT run, ring, {due or '0'} AS due, (row_number() OVER (ORDER BY run) - 1 - {start} + count(*) OVER ()) % count(*) OVER () AS turn FROM q GROUP BY run, ring),
d AS (SELECT q.*, p.due, turn, n <= {budget} AS fits FROM q JOIN p USING (run) WHERE step <= due),
b AS (SELECT *, coalesce(sum(CASE WHEN fits THEN n END) OVER (ORDER BY turn, step, example_id, rollout_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
e AS (SELECT min(before) AS edge FROM b WHERE NOT fits AND before > 0),
s AS (SELECT b.*, row_number() OVER (ORDER BY turn, step, example_id, rollout_idx) - 1 AS place FROM b, e WHERE fits AND before < coalesce(edge, {budget} + 1) AND before + n <= {budget}),
t AS (SELECT run, count(*) AS samples, sum(n)::BIGINT AS tokens FROM s GROUP BY run)
{columns}"""


FIRST_STEP = "min(step) + ring % 2"
TURNS_START = 3


@query("I08_multi_run_packer", _fair(262_144, TURNS_START, FIRST_STEP, "SELECT run, samples, tokens, true AS even FROM t"), ("rollouts",))
def i08(spark, d):
    queue, progress = _queue(spark, d)
    grid, _, _ = packing.multi_pack(queue, progress, 4096, 64, ["example_id", "rollout_idx"], TURNS_START)
    bins = _places(grid, "run")
    # every worker has as many bins of a run, a bin is in one place and holds what fits
    return bins.groupBy("run").agg(F.sum("c").alias("samples"), F.sum("t").cast("long").alias("tokens"), ((F.count("*") == 64 * (F.max("slot") + 1)) & F.bool_and("one") & (F.max("t") <= 4096)).alias("even"))


@query("I09_run_progress", _fair(262_144, TURNS_START, FIRST_STEP, """, r AS (SELECT q.run, min(q.step) AS next FROM q LEFT JOIN s ON q.run = s.run AND q.step = s.step AND q.example_id = s.example_id AND q.rollout_idx = s.rollout_idx WHERE s.run IS NULL GROUP BY q.run)
SELECT p.run, (p.due + CASE WHEN t.run IS NOT NULL AND (r.next IS NULL OR r.next > p.due) THEN 1 ELSE 0 END)::BIGINT AS step, coalesce(t.samples, 0)::BIGINT AS total_samples, coalesce(t.tokens, 0)::BIGINT AS total_tokens, t.run IS NOT NULL AND (r.next IS NULL OR r.next > p.due) AS ready
FROM p LEFT JOIN t USING (run) LEFT JOIN r USING (run)"""), ("rollouts",))
def i09(spark, d):
    queue, progress = _queue(spark, d)
    return packing.multi_pack(queue, progress, 4096, 64, ["example_id", "rollout_idx"], TURNS_START)[1]


@query("K08_run_queues", _fair(262_144, 0, FIRST_STEP, "SELECT run, step, example_id, rollout_idx, place::INT AS turn FROM s"), ("rollouts",))
def k08(spark, d):
    queue, progress = _queue(spark, d)
    return packing.select_fair(queue, progress, 262_144, ["example_id", "rollout_idx"]).select("run", "step", "example_id", "rollout_idx", "turn")


@query("K10_enough_tokens", "WITH b AS (SELECT event_id, coalesce(sum(floor(value)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) SELECT event_id FROM b WHERE before < 5000")
def k10(spark, d):
    return packing.enough_at(table(spark, d, "events").select("event_id", F.floor("value").alias("n")), ["event_id"], "n", 5000).select("event_id")
