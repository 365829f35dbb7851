"""Sockets, requests in flight, rates and timers."""

import json
import random
import threading
import time
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolloutframe import extensions
from rolloutframe.sources import mailbox
from rolloutframe.streaming import operators as O
from rolloutframe.streaming import scheduling, timers
from rolloutframe.streaming.fan_out import FanOut


def name():
    return f"t_{uuid.uuid4().hex}"


def fed(spark, tmp_path, schema, *files):
    """(stream of one file a micro-batch, a function that adds a file)."""
    where, at = tmp_path / uuid.uuid4().hex, iter(range(1000))
    where.mkdir()

    def add(rows):
        n = next(at)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(where / f"f={n:04d}"))
        time.sleep(0.02)  # files are read in the order of their times

    for rows in files:
        add(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(where)), add


# sockets


def part(*ids):
    return mailbox.packed([pa.RecordBatch.from_pydict({"id": list(ids)})])


def held(box, topic=mailbox.BATCHES):
    with mailbox.Client(box.address) as c:
        ends = c.ask("offsets", topic=topic)[0]["ends"]
        out = []
        for sender, end in sorted(ends.items()):
            for n in range(end):
                for b in mailbox.unpacked(c.ask("fetch", topic=topic, sender=sender, number=n)[1]):
                    out += b.column("id").to_pylist()
        return out


def test_a_batch_arrives_whole_and_once():
    with mailbox.Mailbox(stale=0.2) as box:
        with mailbox.Client(box.address) as c:
            c.ask("publish", sender="a", batch=0, tokens=[c.stage("a", "batches", part(1)), c.stage("a", "batches", part(2))])
            c.stage("a", "batches", part(99))  # the sender dies before it publishes
        with mailbox.Client(box.address) as c:  # and comes back: it sends batch 0 again, then batch 1
            assert c.ask("last", sender="a")[0] == {"batch": 0}
            assert c.ask("publish", sender="a", batch=0, tokens=[c.stage("a", "batches", part(1, 2))])[0] == {"again": True}
            c.ask("publish", sender="a", batch=1, tokens=[c.stage("a", "batches", part(3))])
            c.ask("publish", sender="b", batch=0, tokens=[c.stage("b", "batches", part(4))])
            with pytest.raises(RuntimeError, match="not here"):
                c.ask("publish", sender="b", batch=1, tokens=["none"])
            time.sleep(0.3)
            c.stage("c", "batches", part(5))
            assert [t[1] for t in box.staged.values()] == ["c"]  # what was staged and never published has gone
            assert held(box) == [1, 2, 3, 4]
            c.ask("release", topic="batches", ends={"a": 2})
            with pytest.raises(RuntimeError, match="not here"):
                c.ask("fetch", topic="batches", sender="a", number=0)
            assert c.ask("fetch", topic="batches", sender="a", number=2)[1]


def test_senders_wait_while_the_mailbox_is_full():
    with mailbox.Mailbox(capacity=1500) as box, mailbox.Client(box.address) as c:
        big = part(*range(100))
        c.ask("publish", sender="a", batch=0, tokens=[c.stage("a", "batches", big)])
        waits = threading.Thread(target=lambda: mailbox.Client(box.address).stage("a", "batches", big))
        waits.start()
        waits.join(0.3)
        assert waits.is_alive() and not box.staged
        c.ask("release", topic="batches", ends={"a": 1})
        waits.join(5)
        assert len(box.staged) == 1 and box.held == len(big)


def test_a_batch_larger_than_the_mailbox_is_taken():
    numbers = [part(*range(k * 100, k * 100 + 100)) for k in range(5)]
    with mailbox.Mailbox(capacity=1500) as box, mailbox.Client(box.address) as c:
        # waiting for room would never end: none of the batch can be fetched before all of it is here
        answers = [c.ask("stage", p, sender="a", topic="batches")[0] for p in numbers]
        assert all("token" in a for a in answers)
        assert box.memory <= 1500 < box.held
        c.ask("publish", sender="a", batch=0, tokens=[a["token"] for a in answers])
        assert c.ask("stage", numbers[0], sender="a", topic="batches")[0] == {"full": True}  # the next one waits
        assert held(box) == list(range(500))
        c.ask("release", topic="batches", ends={"a": 5})
        assert (box.held, box.waiting, box.memory) == (0, 0, 0) and not list(mailbox.Path(box.files.name).iterdir())


def test_streams_through_a_mailbox_go_on_where_they_stopped(spark, tmp_path):
    schema = "run_id long, step long, payload string"
    s, add = fed(spark, tmp_path, schema, [(1, 0, "a"), (2, 0, "b")])
    with mailbox.Mailbox() as box:
        came = mailbox.read_mailbox(spark, box.address, s.schema)
        path = str(tmp_path / "in")

        def receive():
            q = O.started(came, path, processingTime="0 seconds")
            q.processAllAvailable()
            q.stop()
            return sorted((r.run_id, r.step, r.payload) for r in O.result(came, path).collect())

        mailbox.write_mailbox(s, box.address, "a", str(tmp_path / "out")).awaitTermination()
        assert receive() == [(1, 0, "a"), (2, 0, "b")]
        assert box.held == 0 or all(n > 0 for n in box.ends["batches"].values())
        add([(1, 1, "c")])
        add([(1, 2, None)])
        mailbox.write_mailbox(s, box.address, "a", str(tmp_path / "out")).awaitTermination()
        # a sender that has lost its checkpoint sends all again under its name: passed over
        mailbox.write_mailbox(s, box.address, "a", str(tmp_path / "out_again")).awaitTermination()
        assert receive() == [(1, 0, "a"), (1, 1, "c"), (1, 2, None), (2, 0, "b")]
        assert receive() == [(1, 0, "a"), (1, 1, "c"), (1, 2, None), (2, 0, "b")]


def test_transports_of_tables(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("run_id"), F.lit(0).cast("long").alias("step"), F.col("id").alias("sample"))
    with mailbox.Mailbox() as box:
        sender, receiver = extensions.make_transport("socket", spark, box.address, schema=rows.schema)
        sender.send(rows)
        sender.send(rows.limit(0))
        assert sorted(r.sample for r in receiver.receive().collect()) == list(range(40))
        assert receiver.receive().count() == 0
        sender.send(rows.where("sample = 7"))
        assert [r.sample for r in receiver.receive().collect()] == [7]
        grid = spark.range(12).select(F.col("id").alias("slot"), (F.col("id") % 3).alias("worker"))
        extensions.make_transport("socket", spark, box.address, micro=True)[0].send(grid)
        for rank in range(3):
            got = mailbox.SocketReceiver(spark, box.address, grid.schema, True, rank).receive()
            assert sorted(r.slot for r in got.collect()) == [rank, rank + 3, rank + 6, rank + 9]


def test_a_small_mailbox_relays_a_larger_stream(spark, tmp_path):
    files = [[(i, f"{i}" * 50) for i in range(k * 50, k * 50 + 50)] for k in range(4)]
    s, _ = fed(spark, tmp_path, "id long, text string", *files)
    got = O.relay(s, "a", capacity=20_000)
    assert sorted((r.id, r.text) for r in got.collect()) == [x for f in files for x in f]
    empty, _ = fed(spark, tmp_path, "id long, text string", [])
    assert O.relay(empty, "a").count() == 0


# requests in flight

SCHEMA = "run long, at long, kind string, id long"


def events(n, seed, first=0):
    r = random.Random(seed)
    kinds = r.choices(["request", "finish", "version"], [5, 4, 1], k=n)
    return [(i % 2, first + i, k, first + i if k != "finish" else None) for i, k in enumerate(kinds)]


@pytest.mark.parametrize("restart", [False, True])
def test_no_more_than_the_limit_are_in_flight(spark, tmp_path, restart):
    rows = events(240, 1)
    s, _ = fed(spark, tmp_path, SCHEMA, *[rows[i : i + 60] for i in range(0, 240, 60)])
    got = sorted(O.drain(scheduling.in_flight(s, 3, 5, restart), name()).collect(), key=lambda r: r.at)
    assert len(got) == 240 and max(r.flying for r in got) == 3
    for run in (0, 1):
        queue, flying, pending, done = [], [], None, 0
        for r in (x for x in got if x.run == run):
            if r.kind == "request":
                queue.append(r.at)
            if r.kind == "finish" and flying:
                flying.pop(0)
                done += 1
                assert r.batch == (done // 5 - 1 if done % 5 == 0 else None)
            else:
                assert r.batch is None
            if r.kind == "version":
                pending = r.at
                if restart:
                    queue, flying = flying + queue, []
            if pending is not None and not flying:
                assert r.version == pending
                pending = None
            else:
                assert r.version is None
            if pending is not None:
                assert r.started == []
            assert queue[: len(r.started)] == r.started
            queue, flying = queue[len(r.started) :], flying + r.started
            assert (r.flying, r.queued) == (len(flying), len(queue))
            assert pending is not None or len(flying) == 3 or not queue


def test_a_named_request_finishes(spark, tmp_path):
    s, _ = fed(spark, tmp_path, SCHEMA, [(1, i, "request", i) for i in range(4)] + [(1, 5, "finish", 1), (1, 6, "finish", 77), (1, 7, "checkpoint", None)])
    got = {r.at: r for r in O.drain(scheduling.in_flight(s, 2, 9), name()).collect()}
    assert got[5].started == [2] and got[6].started == []
    assert (got[7].flying_ids, got[7].queued_ids) == ([0, 2], [3])


def test_a_restart_from_a_checkpoint_gives_the_same(spark, tmp_path):
    first, rest = events(90, 2), events(90, 3, 1000)
    marks = [(run, 500, "checkpoint", None) for run in (0, 1)]
    s, _ = fed(spark, tmp_path, SCHEMA, first + marks, rest)
    whole = O.drain(scheduling.in_flight(s, 4, 6), name())
    told = lambda df: sorted((r.run, r.at, r.kind, tuple(r.started), r.flying, r.queued, r.version, r.batch) for r in df.where("at >= 1000").collect())
    # the state that the checkpoint shows, with what has been counted until then
    done = whole.where("at < 500").groupBy("run").agg(F.max("version").alias("version"), F.coalesce(F.max("batch") + 1, F.lit(0)).alias("batch"), F.sum((F.col("kind") == "finish").cast("long")).alias("_f"))
    rows = {r.run: r for r in whole.where("kind = 'checkpoint'").collect()}
    counts = {r.run: r for r in done.collect()}
    asked = {run: [e[1] for e in first if e[0] == run and e[2] == "version"] for run in (0, 1)}
    finished = {run: len({x for r in whole.where(f"run = {run} and at < 500").collect() for x in r.started}) - len(rows[run].flying_ids) for run in (0, 1)}
    state = [(run, rows[run].queued_ids, rows[run].flying_ids, max(asked[run]) if asked[run] and (counts[run].version or -1) < max(asked[run]) else None, counts[run].version, counts[run].batch, finished[run] - 6 * counts[run].batch) for run in (0, 1)]
    s, _ = fed(spark, tmp_path, SCHEMA, rest)
    again = O.drain(scheduling.in_flight(s, 4, 6, state=spark.createDataFrame(state, scheduling.STATE)), name())
    assert told(again) == told(whole)


# rates


@pytest.mark.parametrize("strict", [False, True])
def test_rates(spark, tmp_path, strict):
    r = random.Random(7)
    times = sorted((k, r.randint(0, 3000)) for k in (1, 2) for _ in range(60))
    rows = [(k, i, t) for i, (k, t) in enumerate(times)]
    rows.sort(key=lambda x: (x[2], x[1]))
    s, _ = fed(spark, tmp_path, "run long, id long, at long", rows[:50], rows[50:])
    limit, period = 7, 500
    got = O.drain(scheduling.rate_limited(s, limit, period, strict), name()).collect()
    table = scheduling.starts(spark.createDataFrame(rows, "run long, id long, at long"), limit, period, strict).collect()
    assert sorted((x.run, x.id, x.at, x.start) for x in got) == sorted((x.run, x.id, x.at, x.start) for x in table)
    for k in (1, 2):
        own = sorted((x.at, x.id, x.start) for x in got if x.run == k)
        start = [x[2] for x in own]
        assert start == sorted(start) and all(s >= a for a, _, s in own) and any(s > a for a, _, s in own)
        if strict:  # no stretch of a period holds more
            assert all(b - a >= period for a, b in zip(start, start[limit:], strict=False))
            assert all(s == a or n >= limit and s == start[n - limit] + period for n, (a, _, s) in enumerate(own))
        else:  # by letting a bucket leak, in parts of a request
            fill, last = 0.0, 0
            for a, _, s in own:
                fill = max(0.0, fill - (s - last) * limit / period)
                assert fill + 1 <= limit + 1e-9
                earlier = max(a, last)
                if s > earlier:  # one unit earlier there was no room
                    assert fill + limit / period + 1 > limit - 1e-9
                fill, last = fill + 1, s


# timers


def at(second):
    return f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"


def stamped(spark, tmp_path, *files):
    s, add = fed(spark, tmp_path, "run long, ts string, tokens long", *files)
    return s.withColumn("ts", F.col("ts").cast("timestamp")), add


def test_alarms_fire_without_a_row_and_once(spark, tmp_path):
    s, _ = stamped(spark, tmp_path, [(1, at(0), 0), (2, at(0), 0)], [(2, at(5), 0)], [(2, at(30), 0)], [(2, at(40), 0)], [(1, at(41), 0), (2, at(44), 0)], [(2, at(60), 0)])
    got = sorted((r.run, r.last % 3_600_000 // 1000, r.alarm - r.last) for r in O.drain(timers.alarms(s, 10_000), name()).collect())
    # run 1: silent from 0 and, after a beat, from 41; run 2: from 5 and from 44
    assert got == [(1, 0, 10_000), (1, 41, 10_000), (2, 5, 10_000), (2, 44, 10_000)]


def test_waiting_ends_without_a_row(spark, tmp_path):
    s, _ = stamped(spark, tmp_path, [(1, at(0), 3), (2, at(0), 50)], [(1, at(2), 3), (2, at(3), 50)], [(2, at(20), 1)], [(2, at(21), 1)], [(1, at(22), 100), (2, at(40), 1)], [(2, at(41), 1)])
    got = sorted((r.run, r.batch, r.rows, r.tokens, r.reason, r.at % 3_600_000 // 1000) for r in O.drain(timers.enough_or_timeout(s, 100, 10_000), name()).collect())
    assert got == [(1, 0, 2, 6, "timeout", 10), (1, 1, 1, 100, "full", 22), (2, 0, 2, 100, "full", 3), (2, 1, 2, 2, "timeout", 30)]


def test_timers_of_the_clock_fire_with_no_row_at_all(spark, tmp_path):
    s, add = stamped(spark, tmp_path, [(1, at(0), 3), (1, at(0), 4)])
    out = timers.enough_or_timeout(s, 100, 1500, live=True)
    path = str(tmp_path / "live")
    q = O.started(out, path, processingTime="200 milliseconds")
    try:
        until = time.time() + 60
        while time.time() < until and not O.exists(spark, f"{path}/rows"):
            time.sleep(0.2)
        while time.time() < until and O.result(out, path).count() == 0:
            time.sleep(0.3)
        time.sleep(2.5)
    finally:
        q.stop()
    assert [(r.run, r.batch, r.rows, r.tokens, r.reason) for r in O.result(out, path).collect()] == [(1, 0, 2, 7, "timeout")]


def test_heartbeats_of_queries(spark, tmp_path):
    now = [0.0]
    beat = timers.Heartbeat(lambda: now[0])
    spark.streams.addListener(beat)
    try:
        s, _ = fed(spark, tmp_path, "id long", [(1,)])
        q = s.writeStream.format("noop").queryName("slow").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        until = time.time() + 20
        while time.time() < until and "slow" not in beat.names.values():
            time.sleep(0.1)
        assert beat.overdue() == []
        until, now[0] = time.time() + 0, 10_000.0
        q_id = next(k for k, v in beat.names.items() if v == "slow")
        beat.beats[q_id] = 0.0  # as of a query that hangs since
        assert "slow" in beat.overdue(1800)
        q.stop()
        until = time.time() + 20
        while time.time() < until and q_id in beat.beats:
            time.sleep(0.1)
        assert beat.overdue(1800) == []
    finally:
        spark.streams.removeListener(beat)


def test_offsets_are_plain_json():
    assert json.loads(json.dumps({"a": 3})) == {"a": 3}
    assert [(p.sender, p.start, p.end) for p in mailbox._parts({"a": 1}, {"a": 3, "b": 2, "c": 0})] == [("a", 1, 3), ("b", 0, 2)]


def test_a_failing_sink_gets_its_batches_later_in_order_and_once(spark, tmp_path):
    s, add = fed(spark, tmp_path, "id long", [(1,)], [(2,)], [(3,)])
    taken, calls = {"good": [], "bad": []}, []

    def sink(name, fails):
        def take(rows, batch):
            calls.append((name, batch))
            if fails and sum(n == name for n, _ in calls) in fails:
                raise OSError("away")
            taken[name].append((batch, sorted(r.id for r in rows.collect())))

        return take

    fan = FanOut({"bad": sink("bad", {1, 2}), "good": sink("good", set())}, str(tmp_path / "ledger"))

    def run():
        s.writeStream.foreachBatch(fan).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert taken["good"] == [(0, [1]), (1, [2]), (2, [3])] == taken["bad"]
    assert [e[:2] for e in fan.errors] == [("bad", 0), ("bad", 0)]
    add([(4,)])
    run()
    fan(spark.createDataFrame([(4,)], "id long"), 3)  # the same batch once more
    assert taken["bad"][-1] == (3, [4]) == taken["good"][-1] and len(taken["bad"]) == 4 and fan.settle(spark) == []
