"""Golden cases and invariants of the operators on tiny inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rolloutframe.functions import scalars as S
from rolloutframe.operators import advantage, datasets, metrics, packing, pools, tokens, trajectory


def rewards(spark, groups, lengths=None):
    rows = [(e, i, float(r), float(lengths[e][i]) if lengths else 1.0) for e, g in enumerate(groups) for i, r in enumerate(g)]
    return spark.createDataFrame(rows, "example_id long, i long, reward double, length double")


def test_mean_advantage(spark):
    out = advantage.group_advantage(rewards(spark, [[1, 0.5, 0.8], [0.2, 0.9, 0.1]])).groupBy("example_id").agg(F.avg("advantage").alias("m")).collect()
    assert all(abs(r.m) < 1e-6 for r in out)


def test_length_shaped_advantage(spark):
    out = advantage.group_advantage(rewards(spark, [[1, 0.5, 0.8]], [[10, 20, 10]]), length="length", alpha=0.33).orderBy("i").collect()
    assert [r.advantage for r in out] == pytest.approx([0.20915856, -0.25799648, 0.04883792], abs=1e-6)


def test_custom_advantage(spark):
    out = advantage.custom_advantage(rewards(spark, [[1, 0.5, 0.8]]), lambda r, over: r * 2).orderBy("i").collect()
    assert [r.advantage for r in out] == pytest.approx([2, 1, 1.6])


def test_rectangular_raises(spark):
    with pytest.raises(Exception, match="rollouts"):
        advantage.rectangular(rewards(spark, [[1, 2], [1]]), 2).collect()


def test_pools(spark):
    rows = [("a", e, r) for e, r in enumerate([1.0, 1.0, 0.5, 0.5, 0.0]) for _ in range(2)]
    df = spark.createDataFrame(rows, "env_name string, example_id long, reward double")
    got = {r.pool: r["count"] for r in pools.assign(df, 1.0, 0.0).groupBy("pool").count().collect()}
    assert got == {"easy": 2, "hard": 1, "normal": 2}
    assert pools.online_filter(df).count() == 4


def test_online_filter_six_kept(spark):
    rows = [("a", e, r) for e, r in enumerate([1.0, 0.5, 0.0, 0.5, 0.5]) for _ in range(2)]
    assert pools.online_filter(spark.createDataFrame(rows, "env_name string, example_id long, reward double")).count() == 6


def test_pools_with_colliding_ids(spark):
    rows = [("a", 1, 1.0), ("a", 1, 1.0), ("b", 1, 0.0), ("b", 1, 0.0)]
    df = spark.createDataFrame(rows, "env_name string, example_id long, reward double")
    assert {(r.env_name, r.pool) for r in pools.assign(df, 1.0, 0.0).collect()} == {("a", "easy"), ("b", "hard")}
    assert metrics.solve_rates(df, "reward").first().solve_none == 0  # over all, ids alone group


def test_latest_zero_returns_all(spark):
    df = spark.range(5)
    assert pools.latest(df, 0, ["id"]).count() == 5
    assert [r.id for r in pools.latest(df, 2, ["id"]).collect()] == [4, 3]


def test_env_ratio_band(spark):
    p = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "env_name string, probability double")
    n = pools.sample_envs(spark.range(100).withColumnRenamed("id", "draw"), p).where("env_name = 'a'").count()
    assert 60 <= n <= 95


@pytest.mark.parametrize(("n", "c", "k", "p"), [(4, 0, 1, 0.0), (4, 4, 2, 1.0), (4, 3, 2, 1.0), (4, 2, 2, 1 - 1 / 6), (5, 1, 4, 0.8)])
def test_pass_at_k(spark, n, c, k, p):
    row = spark.range(1).select(metrics.pass_at(F.lit(n), F.lit(c), F.lit(k)).alias("p")).first()
    assert row.p == pytest.approx(p)


def test_lower_median_and_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert metrics.distribution(df, "v").first()["median"] == 2.0
    row = metrics.lag_stats(df, "v").first()
    assert (row["median"], row.p90) == (2.5, pytest.approx(3.7))
    assert math.isnan(metrics.distribution(df.where("v > 9"), "v").first()["mean"])


def test_filters(spark):
    df = spark.createDataFrame([([5, 120_000, 3], [-1.0, -20.0, -1.0], [True] * 3, None)], "ids array<int>, lp array<double>, completion_mask array<boolean>, stop_condition string")
    g = tokens.gibberish_index(F.col("ids"), F.col("lp"), 100_000, 128_000, 2.0)
    r = tokens.repetition_index(F.transform("lp", lambda x: F.lit(-0.001)), 2, 0.99)
    assert df.select(g.alias("g"), r.alias("r")).first() == (1, 1)
    out = tokens.apply_filters(df, [("gibberish", g.isNotNull(), True), ("repetition", r.isNotNull(), False)]).first()
    assert (out.detected_by, out.stop_condition, out.completion_mask) == ("gibberish", "gibberish", [False] * 3)
    assert (out["filter/gibberish"], out["filter/repetition"]) == (1, 0)


def test_masked_nll(spark):
    rows = [(1, -0.1, True), (1, -0.5, False), (1, -0.2, True)]
    row = tokens.masked_nll(spark.createDataFrame(rows, "seq_id long, trainer double, mask boolean")).first()
    assert row.nll / 2 == pytest.approx(0.15)


def test_zero_advantage_takes_the_low_side(spark):
    rows = [(1, 0, math.log(0.9), math.log(0.1), 0.0, True), (1, 1, math.log(0.1), math.log(0.9), 0.0, True)]
    t = tokens.loss_columns(spark.createDataFrame(rows, "seq_id long, pos int, trainer double, inference double, advantage double, mask boolean")).orderBy("pos").collect()
    assert [r.invalid for r in t] == [False, True]


def test_reverse_kl(spark):
    a = F.array(F.lit(1.0), F.lit(2.0), F.lit(-1.0))
    b = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(tokens.reverse_kl(a, a).alias("same"), tokens.reverse_kl(a, b).alias("kl")).first()
    p = [math.exp(x) / sum(math.exp(y) for y in (1, 2, -1)) for x in (1, 2, -1)]
    assert row.same == pytest.approx(0)
    assert row.kl == pytest.approx(sum(x * math.log(3 * x) for x in p))


def step(i, prompt, completion, lp=None, **more):
    return {"step_idx": i, "prompt_ids": prompt, "completion_ids": completion, "completion_mask": [True] * len(completion), "completion_logprobs": lp or [-0.1] * len(completion), "midgen": False} | more


STEPS = "rollout_id long, error boolean, temperature double, steps array<struct<step_idx:int,prompt_ids:array<int>,completion_ids:array<int>,completion_mask:array<boolean>,completion_logprobs:array<double>,midgen:boolean>>"


def folded(spark, rollouts, **more):
    """Samples of each rollout, by the operator. rollouts: (steps, error)."""
    rows = [(i, error, 0.5, [tuple(s.values()) for s in steps]) for i, (steps, error) in enumerate(rollouts)]
    out = {i: [] for i in range(len(rollouts))}
    for r in trajectory.interleave(spark.createDataFrame(rows, STEPS), **more).orderBy("rollout_id", "sample_idx").collect():
        out[r.rollout_id].append(r.asDict())
    return [out[i] for i in range(len(rollouts))]


def test_interleave_golden(spark):
    ((s,),) = folded(spark, [([step(0, [1, 2], [3, 4], [-0.1, -0.2]), step(1, [1, 2, 3, 4, 5, 6], [7, 8], [-0.3, -0.4])], False)])
    assert (s["prompt_ids"], s["completion_ids"]) == ([1, 2], [3, 4, 5, 6, 7, 8])
    assert s["completion_mask"] == [True, True, False, False, True, True]
    assert s["completion_logprobs"] == [-0.1, -0.2, 0.0, 0.0, -0.3, -0.4]


def test_interleave_breaks_agents_and_errors(spark):
    steps = [step(0, [1], [2]), step(1, [1, 2, 3], [4]), step(2, [9], [8]), step(3, [9, 8, 7], [6]), step(4, [1, 2, 3, 4, 5], [5])]
    good, bad, apart = folded(spark, [(steps, False), (steps, True), ([step(0, [1], [2]), step(1, [1, 2, 3], [4], midgen=True)], False)])
    assert [s["step_ids"] for s in good] == [[0, 1, 4], [2, 3]]
    assert not any(any(s["completion_mask"]) for s in bad)
    assert len(apart) == 2


def walked(steps, error):
    """Samples by walking over the steps with whole token lists."""
    open_ = []
    for s in sorted(steps, key=lambda s: s["step_idx"]):
        p, c = s["prompt_ids"], s["completion_ids"]
        home = None if s["midgen"] else next((o for o in open_ if len(o["all"]) < len(p) and p[: len(o["all"])] == o["all"]), None)
        if home is None:
            home = {"all": p, "step_ids": [], "prompt_ids": p, "mask": [], "lp": []}
            open_.append(home)
        extra = len(p) - len(home["all"])
        home["step_ids"].append(s["step_idx"])
        home["mask"] += [False] * extra + [m and not error for m in s["completion_mask"]]
        home["lp"] += [0.0] * extra + s["completion_logprobs"]
        home["all"] = p + c
    return open_


@pytest.mark.parametrize("token", [trajectory.token_hash, lambda place, x: F.lit(0).cast("long"), lambda place, x: x.cast("long") % 2], ids=["hash", "all collide", "many collide"])
def test_interleave_against_a_walk(spark, token):
    rng = random.Random(7)
    rollouts = []
    for _ in range(150):
        steps, ends = [], [[]]
        for i in range(rng.randint(1, 7)):
            p = rng.choice(ends) + [rng.randint(0, 1) for _ in range(rng.randint(0, 3))]
            c = [rng.randint(0, 1) for _ in range(rng.randint(0, 3))]
            steps.append(step(i, p, c, [-rng.random() for _ in c], completion_mask=[rng.random() < 0.7 for _ in c], midgen=rng.random() < 0.1))
            ends.append(p + c)
        rng.shuffle(steps)
        rollouts.append((steps, rng.random() < 0.2))
    for (steps, error), got in zip(rollouts, folded(spark, rollouts, token=token), strict=True):
        expected = walked(steps, error)
        assert [s["step_ids"] for s in got] == [e["step_ids"] for e in expected]
        assert [s["prompt_ids"] + s["completion_ids"] for s in got] == [e["all"] for e in expected]
        assert [s["prompt_ids"] for s in got] == [e["prompt_ids"] for e in expected]
        assert [s["completion_mask"] for s in got] == [e["mask"] for e in expected]
        assert [s["completion_logprobs"] for s in got] == [e["lp"] for e in expected]
        assert all(s["completion_temperatures"] == [0.5] * len(s["completion_ids"]) for s in got)


def test_interleave_stays_in_the_engine(spark):
    plan = trajectory.interleave(spark.createDataFrame([], STEPS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("token", [trajectory.token_hash, lambda place, x: F.lit(0).cast("long")], ids=["hash", "all collide"])
def test_prefix_pairs(spark, token):
    rng = random.Random(3)
    rows = [(k, t, [rng.randint(0, 1) for _ in range(rng.randint(0, 5))] if rng.random() < 0.9 else None) for k in range(30) for t in range(8)]
    expected = {(k, a, b) for k, a, x in rows for k2, b, y in rows if k == k2 and a < b and x is not None and y is not None and len(y) > len(x) and y[: len(x)] == x}
    got = trajectory.prefix_pairs(spark.createDataFrame(rows, "k long, turn int, ids array<int>"), "k", "turn", "ids", token)
    assert got.columns == ["k", "prefix", "step"] and sorted(map(tuple, got.collect())) == sorted(expected)


def test_fake_samples(spark):
    rows = spark.createDataFrame([(5,), (9,), (5,)], "id long")
    fixed = datasets.fake_samples(rows, "id", 7, 3).collect()
    assert [(r.ids, r.mask) for r in fixed] == [([0, 1, 2, 0, 1, 2, 0], [True] * 7)] * 3
    drawn = [(r.sample, r.ids) for r in datasets.fake_samples(rows, "id", 7, 3, kind="random", length="variable", seed=2).collect()]
    assert drawn[0] == drawn[2] and all(1 <= len(ids) <= 7 and set(ids) <= {0, 1, 2} for _, ids in drawn)
    with pytest.raises(ValueError):
        datasets.fake_samples(rows, "id", 7, 3, kind="other")


def test_interleave_drops_steps_without_tokens(spark):
    good = (0, [1], [2], [True], [-0.1], False)
    rows = [(1, False, 1.0, [good]), (2, False, 1.0, [good, (1, None, [3], [True], [0.0], False)]), (3, False, 1.0, [])]
    assert [r.rollout_id for r in trajectory.interleave(spark.createDataFrame(rows, STEPS)).collect()] == [1]


def test_admission_trim_and_prefix(spark):
    ids = F.array(*[F.lit(i) for i in range(10)])
    events = F.expr("array(named_struct('evict_start', 2, 'tokens_evicted', 3), named_struct('evict_start', 0, 'tokens_evicted', 1))")
    row = spark.range(1).select(trajectory.admission_trim(ids, events).alias("t"), trajectory.common_prefix(ids, F.array(F.lit(0), F.lit(1), F.lit(7))).alias("p")).first()
    assert row.t == [1, 5, 6, 7, 8, 9]
    assert row.p == 2


def test_first_fit():
    assert packing.first_fit([4, 3, 3, 1], 4) == [0, 1, 2, 1]
    assert packing.first_fit([1, 1, 1], 4, [False, True, False]) == [0, 1, 0]


def test_pack_invariants(spark):
    rows = [(1, 0, i, i % 2, 1 + (i * 7) % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id long, step long, sample_id long, lora_idx long, n_tokens long")
    bins = packing.pack(df, 64).join(df, ["run_id", "step", "sample_id"])
    assert bins.count() == 200
    assert bins.groupBy("bin").agg(F.sum("n_tokens").alias("t"), F.count_distinct("lora_idx").alias("l")).where("t > 64 or l > 1").count() == 0


@pytest.mark.parametrize(("n", "w", "slots"), [(4, 2, 2), (5, 2, 3), (7, 1, 7), (11, 4, 3)])
def test_distribute(spark, n, w, slots):
    out = packing.distribute(spark.range(n).withColumnRenamed("id", "bin"), w)
    counts = [r["count"] for r in out.groupBy("worker").count().collect()]
    assert counts == [slots] * w
    assert out.where("is_dummy").count() == slots * w - n


def test_interleave_datasets(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "s string, i long")
    one = [(r.s, r.i) for r in datasets.interleave_first(df, "s", ["i"]).orderBy("position").collect()]
    every = [(r.s, r.i) for r in datasets.interleave_all(df, "s", ["i"]).orderBy("position").collect()]
    assert one == [("a", 0), ("b", 0)]
    assert every == [("a", 0), ("b", 0), ("a", 0), ("b", 1)]


def test_subsets():
    assert datasets.resolve_subsets(None, None) == [(None, "train")]
    assert datasets.resolve_subsets(["x"], None) == [("x", "train")]
    assert datasets.resolve_subsets(None, ["test"]) == [(None, "test")]
    with pytest.raises(ValueError):
        datasets.resolve_subsets(["x"], ["a", "b"])


def test_unknown_role_raises(spark):
    with pytest.raises(Exception, match="unknown role"):
        spark.createDataFrame([("robot",)], "role string").select(datasets.trainable(F.col("role"))).collect()


@pytest.mark.parametrize(("prev", "cur", "want"), [(0, 5, 5), (5, 6, None), (4, 11, 10), (10, 10, None)])
def test_eval_schedule(spark, prev, cur, want):
    assert spark.range(1).select(S.schedule_eval(F.lit(prev), F.lit(cur), 5).alias("s")).first().s == want


def test_policy_pick_is_stable(spark):
    df = spark.range(199).select(S.blake2b_mod(F.concat(F.lit("7:"), F.col("id")), F.lit(3)).alias("p"))
    a, b = ([r.p for r in df.collect()] for _ in range(2))
    assert a == b
    assert min(a.count(i) for i in range(3)) > 40
