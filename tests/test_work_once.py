"""An expression on a row is computed once, not once for each of its uses."""

from pyspark.sql import functions as F

from rolloutframe.operators import events, messages, packing, stacking


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_parsed_once(spark):
    p = plan(spark.range(1).select(events.coerce(F.col("id").cast("string")).alias("e")))
    # the container, its items as lists and as objects, and each field that is a list
    lists = sum(t.startswith("array") for _, t, _ in events.FIELDS)
    assert p.count("from_json") <= 3 + lists


def test_messages_are_encoded_once(spark):
    c = spark.createDataFrame([([("user", "a b")], [("assistant", "c")])], "p array<struct<role: string, content: string>>, c array<struct<role: string, content: string>>")
    out = c.select(messages.fill_tokens(F.col("p"), F.col("c"), lambda t: F.transform(F.split(t, " "), lambda w: F.hash(w))).alias("t"))
    assert plan(out).count("split(") == 2  # the prompt and the whole
    t = out.first().t
    assert len(t.prompt_ids) == len(t.prompt_mask) and len(t.completion_ids) == len(t.completion_logprobs) and all(t.completion_mask) and not any(t.prompt_mask)


def test_rows_are_padded_outside_lambdas(spark):
    rows = spark.createDataFrame([(1, i, list(range(i)), None, [i]) for i in range(1, 4)], "g long, i long, a array<int>, b array<int>, calls array<int>")
    s = stacking.vertical_stack(rows, ["g"], "i", {"a": 9, "b": 0}, "calls")
    assert not any("lambdafunction(concat" in line for line in plan(s).split("\n"))
    assert s.collect() == [(1, [1, 2, 3], [[0, 9, 9], [0, 1, 9], [0, 1, 2]], None, [[1], [2], [3]])]


def test_samples_are_packed_once(spark):
    i = F.col("id")
    df = spark.range(3000).select((i % 7).cast("string").alias("run_id"), (i % 3).alias("step"), i.alias("sample_id"), (i % 2).alias("lora_idx"), (i * 37 % 70).cast("int").alias("n_tokens"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # keys lie across batches
    try:
        laid = packing.single_pack(df, 64, 4)
        assert plan(laid).count("Range (") == 1
        got = laid.collect()
        bins = packing.pack(df, 64).select("run_id", "step", "bin").distinct()
        want = packing.distribute(bins, 4, keys=("run_id", "step")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x.run_id, x.step, x.bin, x.worker, x.slot, x.is_dummy) for x in got} == {(x.run_id, x.step, x.bin, x.worker, x.slot, x.is_dummy) for x in want}
    real = [x for x in got if not x.is_dummy]
    assert sorted((x.sample_id, x.n_tokens) for x in real) == [(n, n * 37 % 70) for n in range(3000)]
    assert all(x.sample_id is None and x.n_tokens is None and x.bin == 0 for x in got if x.is_dummy)


def test_a_queue_is_read_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    i = F.col("id")
    queue = spark.range(600).select((i % 5).alias("run"), F.lit(0).alias("step"), i.alias("idx"), (i * 2).alias("sample_id"), F.lit(0).alias("lora_idx"), (i % 9 + 1).cast("int").alias("n_tokens"))
    queue = queue.mapInArrow(counted, queue.schema)
    progress = spark.range(5).select(i.alias("run"), F.lit(0).alias("step"), F.lit(0).alias("total_samples"), F.lit(0).alias("total_tokens"))
    grid, _, _ = packing.multi_pack(queue, progress, 64, 4, ["idx"])
    got = [x for x in grid.collect() if not x.is_dummy]
    assert read.value <= 2 * 600
    assert 0 < sum(x.n_tokens for x in got) <= 256 and all(x.n_tokens == x.sample_id // 2 % 9 + 1 for x in got)
