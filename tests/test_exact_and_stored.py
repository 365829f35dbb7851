"""Exact quantiles, layouts, run histories and stored images against plain versions."""

import base64
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from rolloutframe.operators import metrics, packing, pools, quantiles, runs
from rolloutframe.sources import images


def test_order_statistics_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 3)
    monkeypatch.setattr(quantiles, "BINS", 7)
    r = random.Random(1)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, 1.0, 1.0 + 2**-52]
    values = {
        "hot": [r.choice([r.gauss(0, 1), r.gauss(0, 1) * 1e-9, 7.0, r.expovariate(1e-3)]) for _ in range(900)],
        "odd": [r.choice(odd) for _ in range(120)],
        "same": [3.5] * 50,
        "few": [2.0, 1.0],
        "none": [None, None],
        None: [r.random() for _ in range(40)] + [None] * 5,
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(4)
    ranks = {"least": F.lit(0), "low": quantiles.lower(0.5), "high": quantiles.upper(0.9), "most": F.col("n") - 1}
    got = {x.k: x for x in quantiles.order_statistics(df, "v", ("k",), ranks).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        own = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v))
        n = len(own)
        assert got[k].n == n
        for name, at in (("least", 0), ("low", math.floor(0.5 * (n - 1))), ("high", math.ceil(0.9 * (n - 1))), ("most", n - 1)):
            want = own[at] if n else None
            assert got[k][name] == want or (want is not None and math.isnan(want) and math.isnan(got[k][name])), (k, name)
    alone = quantiles.order_statistics(df.where("k = 'hot'"), "v", (), {"median": quantiles.lower(0.5)}).first()
    assert alone.median == sorted(values["hot"])[449]
    assert quantiles.order_statistics(df.limit(0), "v", ("k",), ranks).count() == 0


def test_quantiles_of_a_hot_key_are_bounded(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), ((F.col("id") * 7919) % 60_000 / F.lit(7.0)).alias("v"))
    got = {x.k: x for x in metrics.lag_stats(df, "v", ("k",)).collect()}
    for k, rows in (("a", [i for i in range(60_000) if i % 3 == 0]), ("b", [i for i in range(60_000) if i % 3])):
        own = np.array([i * 7919 % 60_000 / 7.0 for i in rows])
        assert (got[k].median, got[k].p90) == (np.quantile(own, 0.5), np.quantile(own, 0.9)) or abs(got[k].p90 - np.quantile(own, 0.9)) < 1e-9
    plan = metrics.lag_stats(df, "v", ("k",))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_layout_of_classes(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["x", "y", None]), r.choice([0, 1, 2])) for i in range(97)]
    df = spark.createDataFrame(rows, "bin long, kind string, run int")
    got = packing.distribute(df, 4, keys=("run",), kind="kind").collect()
    for run in (0, 1, 2):
        places = sorted((x.slot, x.worker) for x in got if x.run == run)
        assert places == [(s, w) for s in range(len(places) // 4) for w in range(4)]
        slots = {}
        for x in got:
            if x.run == run:
                slots.setdefault(x.slot, set()).add(x.kind)
        assert all(len(k) == 1 for k in slots.values())
        for kind in ("x", "y", None):
            own = [b for b, k, n in rows if n == run and k == kind]
            mine = [x for x in got if x.run == run and x.kind == kind]
            assert sorted(x.bin for x in mine if not x.is_dummy) == own and len([x for x in mine if x.is_dummy]) == -len(own) % 4
            assert all(x.bin == own[0] for x in mine if x.is_dummy)


def test_returned_examples_are_the_least_drawn(spark):
    df = spark.createDataFrame([(i, ["easy", "hard", "normal", None][i % 4]) for i in range(60)], "example_id long, pool string")
    got = {x.example_id: x.pool for x in pools.return_fraction(df, 0.3, 5).collect()}
    u = {x.example_id: x.u for x in df.select("example_id", pools.uniform(F.col("example_id"), 5).alias("u")).collect()}
    for pool, first in (("easy", 0), ("hard", 1)):
        own = sorted(range(first, 60, 4), key=lambda i: u[i])
        assert [i for i in own if got[i] == "normal"] == own[:4] and all(got[i] == pool for i in own[4:])
    assert [i for i in got if got[i] is None] == list(range(3, 60, 4)) and len(got) == 60


def replayed(log):
    """(run, state, from, to) by following each run's events."""
    out, now = [], {}
    for run, at, kind in sorted(log, key=lambda x: x[1]):
        state = now.get(run)
        new = {"create": "active", "evict": "evicted" if state in ("active", "evicted") else state, "delete": "deleted" if state else None}[kind]
        if new != state and new is not None:
            out.append([run, new, at, None])
            for x in out[:-1]:
                if x[0] == run and x[3] is None:
                    x[3] = at
            now[run] = new
    return {tuple(x) for x in out}


def test_history_of_runs(spark):
    golden = [("a", 1, "create"), ("a", 2, "evict"), ("a", 3, "delete"), ("a", 4, "evict"), ("a", 5, "create"), ("b", 1, "evict"), ("b", 2, "delete"), ("b", 3, "create"), ("b", 4, "create"), ("c", 1, "create"), ("c", 2, "evict"), ("c", 3, "create")]
    df = spark.createDataFrame(golden, "run string, at long, kind string")
    got = {tuple(x) for x in runs.history(df).collect()}
    assert got == replayed(golden) == {("a", "active", 1, 2), ("a", "evicted", 2, 3), ("a", "deleted", 3, 5), ("a", "active", 5, None), ("b", "active", 3, None), ("c", "active", 1, 2), ("c", "evicted", 2, 3), ("c", "active", 3, None)}
    r = random.Random(3)
    log = [(f"r{r.randint(0, 5)}", i, r.choice(["create", "evict", "delete"])) for i in range(200)]
    df = spark.createDataFrame(log, "run string, at long, kind string")
    assert {tuple(x) for x in runs.history(df).collect()} == replayed(log)
    late = runs.upserted(runs.history(df.where("at < 150")), df.where("at >= 150"))
    assert {tuple(x) for x in late.collect()} == replayed(log)
    probes = spark.createDataFrame([(f"r{k}", t, k * t) for k in range(7) for t in range(-1, 220, 9)], "run string, at long, state_of long")
    for x in runs.state_at(probes, runs.history(df)).collect():
        want = next((s for run, s, a, b in replayed(log) if run == x.run and a <= x.at and (b is None or x.at < b)), None)
        assert x.state == want and x.state_of == int(x.run[1:]) * x.at


def test_images_are_written_once(spark, tmp_path):
    pictures = [b"one", b"two" * 1000]
    urls = ["data:image/png;base64," + base64.b64encode(p).decode() for p in pictures]
    rows = [(i, u) for i, u in enumerate([urls[0], urls[1], urls[0], "https://x/y.png", None, "data:image/png;base64,***", "data:image/png;base64,", "data:text/plain;base64,b25l"])]
    df = spark.createDataFrame(rows, "i long, url string").repartition(3)
    root = f"file://{tmp_path}/images"
    got = {x.i: x.url for x in images.offload(df, "url", root).collect()}
    names = [hashlib.sha256(base64.b64encode(p)).hexdigest()[:16] + ".png" for p in pictures]
    assert [got[i] for i in (0, 1, 2)] == [f"{root}/{names[k]}" for k in (0, 1, 0)]
    assert [got[i] for i in range(3, 8)] == [u for _, u in rows[3:]]
    assert {x.file: bytes(x.content) for x in images.stored(spark, root).collect()} == dict(zip(names, pictures, strict=True))
    assert sorted(p.name for p in (tmp_path / "images").iterdir() if not p.name.endswith(".crc")) == sorted(names)
    again = images.write_images(df.select(images.encoded(F.col("url")).alias("image")), root).collect()
    assert {x.file for x in again} == set(names) and not any(x.written for x in again)


def test_sample_log_files_tell_what_they_hold(spark, tmp_path):
    import pyarrow.parquet as pq

    from rolloutframe import plans
    from rolloutframe.sources import io

    none = F.lit(None).cast("map<string, double>")
    rows = spark.range(5000).select(F.lit(None).cast("string").alias("example_id"), F.col("id").alias("sample_id"), *[F.array("id").alias(c) for c in ("prompt", "completion", "trajectory")], F.lit("a").alias("answer"), F.lit("t").alias("task"), F.struct("id").alias("info"), F.lit(1.0).alias("reward"), F.lit(0.5).alias("advantage"), none.alias("metrics"), none.alias("timing"), F.lit(1).alias("num_input_tokens"), F.lit(2).alias("num_output_tokens"), F.lit("e").alias("env_name"))
    path = str(tmp_path / "log")
    for step in (1, 2):
        io.write_sample_log(io.sample_log(rows.where(f"sample_id % 2 = {step - 1}"), "r", step, "train"), path)
    steps = set()
    for f in (tmp_path / "log").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        assert meta.num_columns == 19
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(19)}
            assert all(c.compression == "SNAPPY" for c in columns.values())
            assert any("DICT" in e for e in columns["env_name"].encodings)
            s = columns["step"].statistics
            assert s.min == s.max  # a filter on a step passes over the others' row groups
            steps.add(s.min)
    assert steps == {1, 2} and "A17_rollout_log_rows" in plans.QUERIES
    plan = spark.read.parquet(path).where("step = 2").select("sample_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(step), EqualTo(step,2)]" in plan
