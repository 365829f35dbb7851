"""Streaming queries over the event table, drained to a table so that they can be checked."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..sources import io, mailbox
from ..streaming import operators as O
from ..streaming import scheduling, timers
from ..streaming.fan_out import FanOut
from ..sources.carriers import table
from ..sources.io import exists
from ..sources.shared import new_path
from .registry import query, r6


def _events(spark, d):
    return O.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _name() -> str:
    return f"stream_{uuid.uuid4().hex}"


@query("K02_group_completion", "SELECT user_id AS example_id, count(*)::INT AS n, round(avg(value), 6) AS mean_reward FROM events WHERE event_id % 5 <> 0 GROUP BY user_id HAVING count(*) >= 3")
def k02(spark, d):
    s = _events(spark, d).select(F.col("user_id").alias("example_id"), F.col("value").alias("reward"), (F.col("event_id") % 5 == 0).alias("failed"))
    return O.drain(O.complete_groups(s, 3), _name()).select("example_id", "n", r6("mean_reward").alias("mean_reward"))


@query("K06_reorder_by_step", "SELECT event_id % 4 AS run_id, event_id // 4 AS step, event_type AS payload FROM events")
def k06(spark, d):
    first = F.lit(0)
    s = _events(spark, d).select((F.col("event_id") % 4).alias("run_id"), (F.floor(F.col("event_id") / 4) + first).cast("long").alias("step"), F.col("event_type").alias("payload"))
    return O.drain(O.in_step_order(s), _name())


@query("K03_staleness_in_versions", "SELECT event_id FROM events WHERE 10 - user_id % 20 <= 4")
def k03(spark, d):
    s = _events(spark, d).withColumn("version", F.col("user_id") % 20)
    return O.drain(O.staleness_filter(s, 10, 4).select("event_id"), _name())


@query("K11_pools_as_rollouts_arrive", "SELECT event_type AS env_name, user_id AS example_id, count(*) AS n, CASE WHEN avg((value > 50)::INT) >= 1 THEN 'easy' WHEN avg((value > 50)::INT) <= 0 THEN 'hard' ELSE 'normal' END AS pool FROM events GROUP BY event_type, user_id")
def k11(spark, d):
    s = _events(spark, d).select(F.col("event_type").alias("env_name"), F.col("user_id").alias("example_id"), (F.col("value") > 50).cast("double").alias("reward"))
    return O.drain(O.pools(s), _name(), "complete").select("env_name", "example_id", "n", "pool")


@query("K12_eval_triggers", "WITH v AS (SELECT DISTINCT user_id % 3 AS run_id, event_id // 50 * 50 AS step FROM events) SELECT run_id, step FROM v WHERE step > 0")
def k12(spark, d):
    s = _events(spark, d).select((F.col("user_id") % 3).alias("run_id"), F.col("event_id").alias("version"))
    return O.drain(O.eval_triggers(s, 50), _name())


@query("X01_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x01(spark, d):
    out = O.drain(O.windowed(_events(spark, d), "ts", "1 hour", "1 day", "value", "event_type"), _name(), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("K01_continuous_batches", "WITH n AS (SELECT user_id % 4 AS run_id, event_id AS idx, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 4) AS c FROM events) SELECT run_id, i // 16 AS batch, idx FROM n WHERE i // 16 < c // 16")
def k01(spark, d):
    s = _events(spark, d).select((F.col("user_id") % 4).alias("run_id"), F.col("event_id").alias("idx"), F.lit(1).cast("long").alias("n"))
    return O.drain(O.continuous_batches(s, rows=16), _name())


@query("K07_exactly_once", "SELECT event_id % 4 AS run_id, event_id // 4 AS step, event_type AS payload FROM events")
def k07(spark, d):
    s = _events(spark, d).select((F.col("event_id") % 4).alias("run_id"), F.floor(F.col("event_id") / 4).cast("long").alias("step"), F.col("event_type").alias("payload"))
    # every batch is delivered twice
    return O.drain(O.in_step_order(s.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")), _name())


@query("A14_socket_batches", "SELECT o_custkey % 5 AS run_id, o_orderkey % 7 AS step, o_orderkey AS sample, o_orderpriority AS payload FROM orders")
def a14(spark, d):
    s = O.read_stream(spark, d, "orders").select((F.col("o_custkey") % 5).alias("run_id"), (F.col("o_orderkey") % 7).alias("step"), F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("payload"))
    return O.relay(s, "orchestrator")


@query("A15_socket_micro_batches", "SELECT o_custkey % 3 AS step, o_orderkey % 4 AS worker, o_orderkey AS slot FROM orders WHERE o_orderkey % 4 <> 3")
def a15(spark, d):
    s = O.read_stream(spark, d, "orders").select((F.col("o_custkey") % 3).alias("step"), (F.col("o_orderkey") % 4).alias("worker"), F.col("o_orderkey").alias("slot"))
    # each worker reads the topic of its rank; those of the fourth are not asked for
    return O.relay(s, "packer", "worker", tuple(mailbox.rank_topic(r) for r in range(3)))


def _quoted(sql: str) -> str:
    """``at`` is a word of DuckDB's grammar."""
    return re.sub(r"\bat\b", '"at"', sql)


def _flights(limit: int, size: int, restart: bool) -> str:
    """SQL that follows the counts of in_flight() event by event, over the runs of the event table."""
    drop = "kind = 'version'" if restart else "false"
    return f"""WITH RECURSIVE e AS (SELECT user_id % 64 AS run, event_id AS at, CASE WHEN event_type IN ('view', 'click') THEN 'request' WHEN event_type = 'signup' THEN 'version' ELSE 'finish' END AS kind,
  row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) AS i FROM events),
s(run, i, at, kind, started, flying, queued, version, batch, pending, n, progress) AS (
  SELECT DISTINCT run, 0::BIGINT, NULL::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM e
  UNION ALL SELECT run, i, at, kind, started, f + started, q - started, synced, CASE WHEN whole THEN n END, CASE WHEN synced IS NULL THEN p END, n + whole::BIGINT, CASE WHEN whole THEN 0 ELSE progress + done END
  FROM (SELECT *, CASE WHEN p IS NOT NULL AND synced IS NULL THEN 0 ELSE least({limit} - f, q) END AS started, done = 1 AND progress + 1 = {size} AS whole
    FROM (SELECT *, CASE WHEN f = 0 THEN p END AS synced
      FROM (SELECT e.run, e.i, e.at, e.kind, CASE WHEN {drop.replace('kind', 'e.kind')} THEN 0 ELSE s.flying - (e.kind = 'finish' AND s.flying > 0)::BIGINT END AS f, s.queued + (e.kind = 'request')::BIGINT + CASE WHEN {drop.replace('kind', 'e.kind')} THEN s.flying ELSE 0 END AS q,
        CASE WHEN e.kind = 'version' THEN e.at ELSE s.pending END AS p, (e.kind = 'finish' AND s.flying > 0)::BIGINT AS done, s.n, s.progress FROM s JOIN e ON e.run = s.run AND e.i = s.i + 1))))
SELECT run, at, started::INT AS started, flying::INT AS flying, queued::INT AS queued, version, batch FROM s WHERE i > 0"""


def flights(spark, d):
    kind = F.when(F.col("event_type").isin("view", "click"), "request").when(F.col("event_type") == "signup", "version").otherwise("finish")
    s = _events(spark, d).select((F.col("user_id") % 64).alias("run"), F.col("event_id").alias("at"), kind.alias("kind"), F.col("event_id").alias("id"))
    return s.withColumn("id", F.when(F.col("kind") != "finish", F.col("id")))


def _told(stream):
    return O.drain(stream, _name()).select("run", "at", F.size("started").alias("started"), "flying", "queued", "version", "batch")


@query("K01_in_flight_limit", _quoted(_flights(3, 4, False)).replace("WHEN event_type = 'signup' THEN 'version' ELSE", "ELSE"))
def k01_limit(spark, d):
    s = flights(spark, d).withColumn("kind", F.when(F.col("kind") == "version", "finish").otherwise(F.col("kind")))
    return _told(scheduling.in_flight(s.withColumn("id", F.when(F.col("kind") == "request", F.col("id"))), 3, 4))


@query("K05_drain_at_version", _quoted(_flights(3, 4, False)))
def k05_drain(spark, d):
    return _told(scheduling.in_flight(flights(spark, d), 3, 4))


@query("K05_restart_at_version", _quoted(_flights(3, 4, True)))
def k05_restart(spark, d):
    return _told(scheduling.in_flight(flights(spark, d), 3, 4, restart=True))


DAY = 86_400_000_000


@query("K14_rate_limit", _quoted(f"""WITH n AS (SELECT user_id AS run, event_id AS id, epoch_us(ts) AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT run, id, at, greatest(at, ceil(((max(at * 2 - n * {DAY}) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + n * {DAY}) - {DAY}) / 2.0)::BIGINT) AS start FROM n"""))
def k14(spark, d):
    s = _events(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("at"))
    return O.drain(scheduling.rate_limited(s, 2, DAY), _name())


@query("K14_rate_limit_of_any_period", _quoted(f"""WITH n AS (SELECT user_id AS run, event_id AS id, epoch_us(ts) AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT run, id, at, max(at - n // 2 * {DAY}) OVER (PARTITION BY run, n % 2 ORDER BY n ROWS UNBOUNDED PRECEDING) + n // 2 * {DAY} AS start FROM n"""))
def k14_strict(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return scheduling.starts(r, 2, DAY, strict=True)


HALF_DAY = 43_200_000


@query("K15_watchdog_alarms", _quoted(f"""WITH b AS (SELECT user_id AS run, epoch_us(ts) // 1000 AS at FROM events), n AS (SELECT run, at, lead(at) OVER (PARTITION BY run ORDER BY at) AS next FROM b)
SELECT run, at AS last, at + {HALF_DAY} AS alarm FROM n WHERE coalesce(next, (SELECT max(at) FROM b)) > at + {HALF_DAY}"""))
def k15_alarms(spark, d):
    return O.drain(timers.alarms(_events(spark, d).select(F.col("user_id").alias("run"), "ts"), HALF_DAY), _name())


@query("K10_enough_or_timeout", _quoted(f"""WITH RECURSIVE b AS (SELECT user_id % 64 AS run, epoch_us(ts) // 1000 AS at, floor(value)::BIGINT AS n, row_number() OVER (PARTITION BY user_id % 64 ORDER BY epoch_us(ts) // 1000, floor(value)) AS i FROM events WHERE value IS NOT NULL),
s(run, i, at, since, rows, tokens, late, late_rows, late_tokens, whole) AS (
  SELECT DISTINCT run, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, false FROM b
  UNION ALL SELECT run, i, at, CASE WHEN whole THEN at ELSE coalesce(since, at) END, r, t, late, lr, lt, t >= 150
  FROM (SELECT run, i, at, since, CASE WHEN gone OR whole0 THEN 0 ELSE rows END + 1 AS r, CASE WHEN gone OR whole0 THEN 0 ELSE tokens END + n AS t, CASE WHEN gone THEN late0 END AS late, rows AS lr, tokens AS lt, false AS whole
    FROM (SELECT b.run, b.i, b.at, b.n, s.rows, s.tokens, s.whole AS whole0, s.since + {HALF_DAY} AS late0, NOT s.whole AND s.since IS NOT NULL AND b.at > s.since + {HALF_DAY} AS gone, CASE WHEN s.whole OR b.at > s.since + {HALF_DAY} THEN NULL ELSE s.since END AS since FROM s JOIN b ON b.run = s.run AND b.i = s.i + 1))),
o AS (SELECT run, late_rows AS rows, late_tokens AS tokens, 'timeout' AS reason, late AS at FROM s WHERE late IS NOT NULL UNION ALL SELECT run, rows, tokens, 'full', at FROM s WHERE whole
  UNION ALL SELECT run, rows, tokens, 'timeout', since + {HALF_DAY} FROM s WHERE i = (SELECT max(i) FROM b WHERE b.run = s.run) AND NOT whole AND since + {HALF_DAY} <= (SELECT max(at) FROM b))
SELECT run, row_number() OVER (PARTITION BY run ORDER BY at) - 1 AS batch, rows, tokens, reason, at FROM o"""))
def k10_timeout(spark, d):
    s = _events(spark, d).where("value is not null").select((F.col("user_id") % 64).alias("run"), "ts", F.floor("value").alias("tokens"))
    return O.drain(timers.enough_or_timeout(s, 150, HALF_DAY), _name())


@query("A22_metric_fan_out", "SELECT 'table' AS sink, event_id, event_type, value FROM events UNION ALL SELECT 'late', event_id, event_type, value FROM events")
def a22(spark, d):
    root = new_path(spark)

    def table_sink(rows, batch):
        rows.write.mode("overwrite").parquet(f"{root}/table/batch={batch}")

    def late_sink(rows, batch):
        if not exists(spark, f"{root}/up"):  # away at first
            io.write_text(spark, f"{root}/up", "")
            raise ConnectionError("the monitor is away")
        rows.write.mode("overwrite").parquet(f"{root}/late/batch={batch}")

    fan = FanOut({"table": table_sink, "late": late_sink}, f"{root}/ledger")
    s = _events(spark, d).select("event_id", "event_type", "value")
    s.writeStream.foreachBatch(fan).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    fan.settle(spark)
    out = None
    for name in ("table", "late"):
        there = exists(spark, f"{root}/{name}")
        rows = spark.read.schema(s.schema).parquet(f"{root}/{name}/*") if there else spark.createDataFrame([], s.schema)
        rows = rows.select(F.lit(name).alias("sink"), "event_id", "event_type", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
