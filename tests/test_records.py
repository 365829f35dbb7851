"""Golden cases and invariants of events, calls, turns, messages, stacks, packers and orders."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rolloutframe import extensions
from rolloutframe.operators import events, messages, ordering, packing, runs, stacking, turns


def one(spark, c, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).select(c).first()[0]


def coerced(spark, raw, **options):
    return spark.createDataFrame([(raw if raw is None else json.dumps(raw),)], "raw string").select(events.coerce(F.col("raw"), **options).alias("e")).first().e


def test_event_forms(spark):
    got = coerced(spark, [{"num_output_tokens_at_compaction": 4, "tokens_evicted": "8", "position_offset_after": 8.0, "archived_span_ids": ["a", "b"]}, [1, 2, 3, 4, 5, 6, [7], [8, 9]], [1, 2], 5, None, "x"])
    assert [(e.num_output_tokens_at_compaction, e.tokens_evicted, e.position_offset_after) for e in got] == [(4, 8, 8), (1, 2, 3)]
    assert (got[0].archived_span_ids, got[0].kept_indices, got[0].last_turn_evicted, got[0].restored_span_pos_start) == (["a", "b"], [], -1, -1)
    assert (got[1].num_prompt_tokens, got[1].evict_start, got[1].new_user_fragment_len, got[1].kept_indices, got[1].kept_token_ids) == (4, 5, 6, [7], [8, 9])
    for raw in (None, [], [[1, 2]]):
        assert coerced(spark, raw) is None
    assert coerced(spark, [{"tokens_evicted": 1}], strict=False) is None
    with pytest.raises(Exception, match="required"):
        coerced(spark, [{"tokens_evicted": 1}])


@pytest.mark.parametrize(
    ("payload", "error", "want"),
    [
        ({"prompt_token_ids": [1, 2], "completion_token_ids": [3, 4], "completion_logprobs": [-0.1, -0.2]}, False, [True, True]),
        ({"prompt_token_ids": [1, 2], "completion_token_ids": [3, 4], "completion_logprobs": [-0.1, -0.2]}, True, [False, False]),
        ({"prompt_token_ids": [1, 2], "completion_token_ids": [3, 4], "completion_logprobs": [-0.1]}, False, None),
        ({"prompt_token_ids": [], "completion_token_ids": [3], "completion_logprobs": [-0.1]}, False, None),
        ({"prompt_token_ids": [1], "completion_token_ids": None, "completion_logprobs": []}, False, None),
        ({"prompt_token_ids": ["x"], "completion_token_ids": [3], "completion_logprobs": [-0.1]}, False, None),
        ("text", False, None),
        (None, False, None),
    ],
)
def test_summary_samples(spark, payload, error, want):
    extras = json.dumps({"summary_trainsample": payload, "compaction_events": []})
    rows = events.summary_samples(spark.createDataFrame([(1, 0, extras, error, 0.7), (2, 0, None, False, 1.0)], "rollout_id long, step_idx int, extras string, error boolean, temperature double")).collect()
    assert [r.completion_mask for r in rows] == ([want] if want else [])
    if want:
        assert (rows[0].prompt_mask, rows[0].completion_temperatures, rows[0].compaction_events) == ([False, False], [0.7, 0.7], None)


def test_summary_events_that_cannot_be_read_are_left_out(spark):
    p = {"prompt_token_ids": [1], "completion_token_ids": [3], "completion_logprobs": [-0.1], "compaction_events": [{"tokens_evicted": 1}, [1, 2, 3]]}
    r = events.summary_samples(spark.createDataFrame([(1, 0, json.dumps({"summary_trainsample": p}), False, 1.0)], "rollout_id long, step_idx int, extras string, error boolean, temperature double")).first()
    assert [e.tokens_evicted for e in r.compaction_events] == [2]


def test_completion_delta_and_trim(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4])], "p array<int>, f array<int>")
    assert df.select(events.completion_delta(F.col("p"), F.col("f"))).first()[0] == [3, 4]
    with pytest.raises(Exception, match="prefix"):
        df.select(events.completion_delta(F.col("f"), F.col("p"))).collect()
    call = "struct<completion_ids: array<int>, completion_logprobs: array<double>, completion_temperatures: array<double>, trailing_pad_ids: array<int>>"
    c = ([1, 2, 3], [0.0] * 3, [1.0] * 3, [9, 9])
    df = spark.createDataFrame([([c, c],)], f"c array<{call}>")
    got = df.select(events.trim_last_call(F.col("c"), F.lit(2))).first()[0]
    assert [(x.completion_ids, x.trailing_pad_ids) for x in got] == [([1, 2, 3], [9, 9]), ([1], [])]
    assert [len(x.completion_ids) for x in df.select(events.trim_last_call(F.col("c"), F.lit(0))).first()[0]] == [3, 3]


def padded(ids, end, block, start=0, filler=0):
    out = []
    for x in ids:
        out.append(x)
        while x == end and (start + len(out)) % block:
            out.append(filler)
    return out


def test_padding_behind_end_tokens(spark):
    r = random.Random(1)
    cases = [[], [7], [1, 7], [1, 2, 3, 4, 7, 5], [7, 7, 1]] + [[r.choice([1, 2, 7]) for _ in range(r.randint(0, 30))] for _ in range(30)]
    df = spark.createDataFrame([(i, c, r.randint(0, 9)) for i, c in enumerate(cases)], "i int, ids array<int>, start int")
    for row in df.select("ids", "start", turns.pad_after_end(F.col("ids"), 7, 4, F.col("start"), 0).alias("p")).collect():
        assert row.p == padded(row.ids, 7, 4, row.start)


@pytest.mark.parametrize(("most", "stride", "guard"), [(1, 1, 0), (2, 1, 0), (3, 1, 0), (3, 2, 0), (2, 5, 0), (4, 3, 16), (1, 1, 5), (3, 2, 5), (5, 2, 3)])
def test_turn_eviction_keeps_a_block_aligned_cache(spark, most, stride, guard):
    r = random.Random(most * 100 + stride * 10 + guard)
    talks = [[([r.randint(10, 99) for _ in range(r.randint(16, 30))] + [7], [r.randint(10, 99) for _ in range(r.randint(1, 9))] + [7], r.random() > 0.2) for _ in range(r.randint(1, 14))] for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*talks, [], None])], "conv_id long, turns array<struct<user_ids: array<int>, completion_ids: array<int>, trainable: boolean>>")
    got = {x.conv_id: x for x in turns.turn_eviction(df, most, stride, 8, 7, guard).collect()}
    assert sorted(got) == list(range(12))
    for n, talk in enumerate(talks):
        row, cache, sizes, begin, offset, ids, mask = got[n], [], [], 0, 0, [], []
        assert len(row.calls) == len(talk)
        for i, (c, (user, answer, trainable)) in enumerate(zip(row.calls, talk, strict=True)):
            fragment = padded(user, 7, 8, 0, turns.FILLER)
            safe = guard or len(padded(user[: user.index(7) + 1], 7, 8)) if i == 0 else safe
            assert c.submitted_prompt_ids == cache + fragment and c.completion_ids == answer
            here = [k for k in range(begin, i)]
            if len(here) >= most:  # full: the oldest turns go
                gone = here[: min(stride, len(here))]
                size = sum(sizes[k] for k in gone)
                begin += len(gone)
                assert (c.evict_start, c.num_turns_evicted_after, c.last_turn_evicted, c.new_user_fragment_len) == (safe, len(gone), len(gone) - 1, len(fragment))
            else:
                size = 0
                assert (c.evict_start, c.num_turns_evicted_after, c.last_turn_evicted, c.new_user_fragment_len) == (0, 0, -1, 0)
            offset += size
            kept = c.submitted_prompt_ids[:safe] + c.submitted_prompt_ids[safe + size :]
            tail = [turns.FILLER] * (-(len(kept) + len(answer)) % 8)
            assert (c.tokens_evicted, c.position_offset_after, c.num_prompt_tokens, c.trailing_pad) == (size, offset, len(kept), len(tail))
            cache = kept + answer + tail
            ids += fragment + answer + tail
            mask += [False] * len(fragment) + [trainable] * len(answer) + [False] * len(tail)
            sizes.append(len(fragment) + len(answer) + len(tail) - (safe if i == 0 else 0))
        assert (row.ids, row.mask) == (ids, mask)
    plan = turns.turn_eviction(df, most, stride, 8, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_message_containers(spark):
    rows = [(None, []), ("null", []), ('"hi"', [("user", "hi")]), ('{"role":"system","content":"s"}', [("system", "s")]), ('["a", {"role":"assistant","content":null}]', [("user", "a"), ("assistant", None)]), ("[]", [])]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, raw string")
    got = {r.i: [(m.role, m.content) for m in r.m] for r in df.select("i", messages.normalize(F.col("raw"), "user").alias("m")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(rows)}
    with pytest.raises(Exception, match="neither"):
        spark.createDataFrame([("[1]",)], "raw string").select(messages.normalize(F.col("raw"), "user").alias("m")).collect()


def test_groups_of_neighbours():
    assert stacking.group_numbers(["s", "s", "s", None, "s", "f", "f"], [4, 4, 4, 1, 4, 4, 4], 2) == [0, 0, 1, 2, 3, 4, 4]
    assert stacking.group_numbers(["s"] * 4, [4, 8, 2, 2], 9, budget=16) == [0, 0, 1, 1]
    assert stacking.group_numbers(["flex_compaction"] * 4, [4, 8, 4, 20], 9, budget=16, horizontal=True) == [0, 0, 0, 1]
    assert stacking.group_numbers(["s", "s"], [99, 99], 1, budget=4) == [0, 1]


def test_levels_that_are_late_rise():
    shelf = stacking.Shelf([256, 512, 1024], 1024, 0)
    assert shelf.add(0, "a") is None and shelf.add(1, "b") is None
    assert shelf.add(2, "c") == (1024, ["c"], "full")
    # one batch since a and b came: with another row the lowest level is late; its two rows and b's level would fill
    assert shelf.add(0, "d") == (256, ["a", "d", None, None], "timeout")
    assert shelf.add(1, "e") == (512, ["b", "e"], "timeout")
    assert shelf.add(0, "f") is None and shelf.add(2, "g") == (1024, ["g"], "full")
    # one row rises over an empty level: two of 512 would not be filled by it, one of 1024 would
    late = stacking.Shelf([256, 512, 1024], 1024, -1)
    assert late.add(0, "x") is None
    assert late.add(0, "y") == (256, ["x", "y", None, None], "timeout")
    assert late.add(0, "z") is None
    late.rows[0] = []
    assert late.add(0, "z") == (512, ["z", None], "timeout")


def test_stacked_batches_fill_their_area(spark):
    r = random.Random(3)
    sizes = {(k, i): r.choice([10, 200, 300, 600, 1000, 5000]) for k in ("a", "b", None) for i in range(400)}
    df = spark.createDataFrame([(k, i, n) for (k, i), n in sizes.items()], "k string, i long, n int").repartition(5)
    rows = stacking.stack_pack(df, 2048, "k", "i", "n", timeout=3).collect()
    batches = {}
    for x in rows:
        batches.setdefault((x.k, x.batch), []).append(x)
    ids = [(x.k, x.i) for x in rows if x.i is not None]
    assert len(ids) == len(set(ids)) > 900
    own = lambda n: next(w for w in (256, 512, 1024, 2048) if min(n, 2048) <= w)
    for got in batches.values():
        width = got[0].width
        assert sorted(x.slot for x in got) == list(range(2048 // width))
        real = [x for x in got if x.i is not None]
        assert all(x.tokens == min(sizes[x.k, x.i], 2048) and own(x.tokens) <= width for x in real) and all(x.tokens == 1 for x in got if x.i is None)
        if got[0].reason == "full":
            assert len(real) == len(got) and all(own(x.tokens) == width for x in real)
    assert {x.reason for x in rows} == {"full", "timeout"} and any(x.i is None for x in rows)
    # without time-outs a width's samples go out in order, room by room
    calm = stacking.stack_pack(df, 2048, "k", "i", "n", timeout=10**6).collect()
    assert {x.reason for x in calm} == {"full"}
    for k in ("a", "b", None):
        for w in (256, 512, 1024, 2048):
            mine = sorted(i for (a, i), n in sizes.items() if a == k and own(n) == w)
            whole = len(mine) - len(mine) % (2048 // w)
            assert sorted(x.i for x in calm if x.k == k and x.width == w) == mine[:whole]


def test_blocks_carry_packs_as_one_pass_does(spark):
    r = random.Random(6)

    def one_pass(sizes, limit):
        out, total, count = [], 0, 0
        for n in sizes:
            total, count = total + n, count + 1
            if total >= limit:
                out.append((len(out), count, total))
                total, count = 0, 0
        return out, total

    for _ in range(300):
        limit, sizes = r.choice([1, 2, 7, 30]), [r.choice([0, 1, 2, 3, 9, 40]) for _ in range(r.randint(1, 12))]
        lows, outs, ends, through = packing.carried(packing.np.array(sizes), limit)
        assert lows == sorted(set(lows))
        for c in range(limit):
            got, rest = one_pass([c, *sizes] if c else sizes, limit)
            i = max((k for k, low in enumerate(lows) if low <= c), default=None)
            assert (len(got), rest) == ((ends[i], outs[i]) if i is not None else (0, c + through)), (c, limit, sizes)
    rows = [(k, i, r.choice([1, 1, 2, 5, 30])) for k in ("a", "b", None) for i in r.sample(range(10**6), 300)]
    df = spark.createDataFrame(rows, "k string, idx long, n_tokens long").repartition(4)
    for block in (1, 7, 1000):
        got = {(x.k, x.pack, x.n_samples, x.n_tokens) for x in packing.cat_pack(df, 17, "k", block=block).collect()}
        assert got == {(k, *p) for k in ("a", "b", None) for p in one_pass([n for a, _, n in sorted(rows, key=lambda x: x[1]) if a == k], 17)[0]}
    assert packing.cat_pack(df.limit(0), 17, "k").count() == 0


def test_mixed_presence_in_a_stack_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, [1, 2], None), (1, 2, [1], [0.5])], "g int, i int, ids array<int>, t array<double>")
    with pytest.raises(Exception, match="only some rows"):
        stacking.vertical_stack(df, ["g"], "i", {"ids": 0, "t": 0.0}).collect()
    row = stacking.vertical_stack(df, ["g"], "i", {"ids": 9}).first()
    assert (row.ids, row.sequence_lengths) == ([[1, 2], [1, 9]], [2, 1])
    with pytest.raises(Exception, match="rectangular"):
        stacking.collate(df, ["g"], "i", ["ids"]).collect()


def visited(queues, budget, start, due):
    """(chosen, next start) by going round the runs one head at a time."""
    ring, chosen, used, at = sorted(queues), [], 0, start
    heads = {k: [x for x in sorted(v) if x[0] <= due[k]] for k, v in queues.items()}  # (step, idx, tokens)
    while used < budget and any(heads.values()):
        run = ring[at % len(ring)]
        at += 1
        for step, i, n in list(heads[run]):
            if used + n > budget and used:
                return chosen, at % len(ring)
            heads[run].pop(0)
            if n <= budget:
                chosen.append((run, step, i))
                used += n
        # the place behind the last run that had a head
        if not any(heads.values()):
            break
    return chosen, at % len(ring)


def test_fair_selection_and_progress_against_queues(spark):
    r = random.Random(4)
    for case in range(6):
        rows = [(f"r{k}", s, i, 10 * i + s, 0, r.choice([1, 2, 5, 40])) for k in range(6) for s in range(3) for i in range(r.randint(0, 6))]
        start, budget = case % 7, (32, 40, 3, 10_000, 7, 24)[case]
        queue = spark.createDataFrame(rows, "run string, step long, idx long, sample_id long, lora_idx int, n_tokens long")
        due = {f"r{k}": k % 3 for k in range(6)}
        progress = spark.createDataFrame([(k, s, 0, 0) for k, s in due.items()], "run string, step long, total_samples long, total_tokens long")
        queues = {k: [(s, i, n) for run, s, i, _, _, n in rows if run == k] for k in due}
        want, following = visited(queues, budget, start, due)
        chosen, then = packing.fair_selection(queue, progress, budget, ["idx"], start)
        assert [(x.run, x.step, x.idx) for x in chosen.orderBy("turn").collect()] == want, case
        assert then == following, case
        if case:
            continue
        grid, after, then = packing.multi_pack(queue, progress, 16, 2, ["idx"], start)
        assert then == following and {(x.run, x.sample_id) for x in grid.where("sample_id is not null").collect()} == {(k, 10 * i + s) for k, s, i in want}
        for x in after.collect():
            mine = [(s, i) for k, s, i in want if k == x.run]
            left = [s for s, i, _ in queues[x.run] if (s, i) not in mine]
            done = bool(mine) and (not left or min(left) > due[x.run])
            assert (x.step, x.ready, x.total_samples) == (due[x.run] + done, done, len(mine))


def test_fair_selection_golden_cases(spark):
    progress = spark.createDataFrame([(k, 0) for k in "abc"], "run string, step long")

    def select(budget, start=0, **queues):
        rows = [(k, 0, i, n) for k, v in queues.items() for i, n in enumerate(v)]
        chosen, then = packing.fair_selection(spark.createDataFrame(rows, "run string, step long, idx long, n_tokens long"), progress, budget, ["idx"], start)
        return [f"{x.run}{x.idx}" for x in chosen.orderBy("turn").collect()], then

    assert select(12, a=[10], b=[5], c=[2]) == (["a0"], 2)
    assert select(12, a=[99, 3], b=[5]) == (["a1", "b0"], 2)
    assert select(12, 1, a=[5], b=[7], c=[9]) == (["b0"], 0)
    assert select(12, 1, a=[5], b=[3, 99, 1], c=[9]) == (["b0"], 2)
    assert select(8, 2, a=[4, 4], c=[4]) == (["c0", "a0"], 1)
    assert select(8, a=[4, 4], b=[99], c=[1]) == (["a0", "a1"], 1)
    assert select(8, 1, a=[99], b=[99], c=[99]) == ([], 1)


def test_numbers_and_sums_of_whole_tables(spark):
    r = random.Random(5)
    rows = [(i, r.choice("aab"), r.randint(0, 9)) for i in r.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "id long, k string, v long").repartition(5)
    order = sorted(rows)
    got = {x.id: x.place for x in ordering.numbered(df, ["id"]).collect()}
    assert got == {i: n for n, (i, _, _) in enumerate(order)}
    by = {x.id: x.n for x in ordering.numbered(df, [F.desc("id")], "n", ("k",)).collect()}
    assert by == {i: n for k in "ab" for n, (i, _, _) in enumerate([x for x in order[::-1] if x[1] == k])}
    sums = {x.id: x.s for x in ordering.running_sum(df, ["id"], F.col("v"), "s", inclusive=False).collect()}
    assert sums == {i: sum(v for _, _, v in order[:n]) for n, (i, _, _) in enumerate(order)}
    framed, w = ordering.framed(df, ["id"], 3, block=16)
    last = {x.id: x.s for x in framed.withColumn("s", F.sum("v").over(w)).where("_own").collect()}
    assert last == {i: sum(v for _, _, v in order[max(0, n - 3) : n + 1]) for n, (i, _, _) in enumerate(order)}
    plan = ordering.numbered(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("Exchange SinglePartition, EXECUTOR_BROADCAST", "") or plan.count("SinglePartition") == 1  # the offsets: a row for each range


def test_exactly_once_and_resume(spark):
    b = spark.createDataFrame([("a", 3), ("a", 4), ("a", 4), ("a", 6), ("b", 1), ("c", 0)], "run string, step long")
    p = spark.createDataFrame([("a", 3), ("b", 0), ("c", 0)], "run string, step long")
    assert sorted((r.run, r.step) for r in runs.accepted(b, p).collect()) == [("a", 3), ("a", 4), ("c", 0)]
    steps = spark.createDataFrame([(2,), (5,)], "step long")
    assert (runs.resume_step(steps), runs.resume_step(steps, 2), runs.resume_step(steps, 3)) == (5, 2, None)


def test_extension_points(spark, tmp_path):
    class Broken(extensions.Monitor):
        def log(self, metrics, step):
            raise OSError("gone")

    good = extensions.TableMonitor(spark, str(tmp_path / "m"))
    both = extensions.MultiMonitor([Broken(), good])
    both.log({"loss": 1.0}, 1)
    both.log({"loss": 0.5}, 2)
    both.save_final_summary()
    assert [(m, n) for m, n, _ in both.errors] == [("Broken", "log")] * 2
    assert spark.read.json(str(tmp_path / "m" / "final_summary")).first().value == 0.5
    hooks = extensions.RunHooks()
    seen = []
    hooks.register("creation", lambda run: seen.append(("new", run)))
    hooks.register("deletion", lambda run: seen.append(("gone", run)))
    hooks.on_change(*runs.changed(spark.createDataFrame([("a",), ("b",)], "run string"), spark.createDataFrame([("b",), ("c",)], "run string")))
    assert sorted(seen) == [("gone", "a"), ("new", "c")]
    with pytest.raises(ValueError, match="unknown transport"):
        extensions.make_transport("pigeon", spark, "x")
    with pytest.raises(ValueError, match="unknown filter"):
        extensions.make_filter({"type": "none"}, 10)


def test_configurations():
    from dataclasses import dataclass

    @dataclass
    class Config:
        steps: int = 1
        name: str = "x"

    hooks = extensions.RunHooks()
    hooks.register("config_validation", lambda c: (c.steps > 0, "steps must be positive"))
    assert extensions.read_config("steps = 3", Config, hooks)[0] == Config(3)
    assert extensions.read_config("steps = 0", Config, hooks) == (None, "steps must be positive")
    assert extensions.read_config("other = 0", Config, hooks)[0] is None
    assert extensions.read_config("steps = ", Config, hooks)[1].startswith("Error parsing")


def test_no_word_ends_a_message(spark, tmp_path):
    # the hash of w355823 is the number of the end token
    con = duckdb.connect()
    con.sql("""SELECT c::BIGINT AS conv_id, t::BIGINT AS turn, CASE WHEN t % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN t = c THEN 'a w355823 b' ELSE repeat('a ', 20) END AS text
    FROM range(4) x(c), range(8) y(t)""").write_parquet(str(tmp_path / "conversations.parquet"))
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet')")
    names = ("conv_id", "tokens", "trained", "calls", "events", "evicted")
    got = entry.queries()["H20_turn_eviction"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(entry.oracle_sql()["H20_turn_eviction"]).select(*names).fetchall())


def filled_and_wanted(spark, path, select):
    con = duckdb.connect()
    con.sql(select).write_parquet(str(path / "conversations.parquet"))
    con.execute(f"create view conversations as select * from read_parquet('{path}/conversations.parquet')")
    got = entry.queries()["H01_filled_tokens"](spark, str(path)).collect()
    return sorted(map(tuple, got)), sorted(con.sql(entry.oracle_sql()["H01_filled_tokens"]).fetchall())


def test_words_of_one_id_are_two_words(spark, tmp_path):
    # the head of the answer has the hash of that head with the answer's first word, in all conversations but the last
    got, want = filled_and_wanted(spark, tmp_path, """SELECT c::BIGINT AS conv_id, t::BIGINT AS turn, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE t WHEN 0 THEN 'de ' || p ELSE a || ' la' END AS text
    FROM (VALUES (0, 'su.', 'Ciónci'), (1, 'Is.', 'Ener'), (2, 'enes.', 'Las'), (3, 'zu.', 'Leeux'), (4, 'the.', 'The')) x(c, p, a), range(2) y(t)""")
    assert got == want == [(c, 1, 2) for c in range(5)]


def test_messages_lose_what_unicode_calls_a_space(spark, tmp_path):
    got, want = filled_and_wanted(spark, tmp_path, """SELECT c::BIGINT AS conv_id, t::BIGINT AS turn, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END AS role, e || ' a' || e || 'b ' || e AS text
    FROM (SELECT row_number() OVER () AS c, chr(s) AS e FROM (VALUES (32), (160), (5760), (8195), (8202), (8239), (8287), (12288), (9), (10), (13), (133), (8203), (8232)) v(s)) x, range(2) y(t)""")
    assert got == want and len(got) == 14


def test_answers_of_one_turn_are_one_completion(spark, tmp_path):
    got, want = filled_and_wanted(spark, tmp_path, """SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 'user', 'a b'), (0, 1, 'assistant', 'c d e'), (0, 1, 'assistant', 'c d e'), (1, 0, 'user', 'a'), (1, 1, 'user', 'b c'), (1, 1, 'assistant', 'd'), (2, 0, 'assistant', NULL), (3, 0, 'user', '')) x(conv_id, turn, role, text)""")
    assert got == want and len(got) == 4
