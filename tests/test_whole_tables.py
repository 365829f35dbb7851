"""Queries run over their whole tables: against SQL over every row, or a plain Python version."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from rolloutframe.functions import scalars as S
from rolloutframe.operators import datasets
from rolloutframe.sources.carriers import TABLES


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{os.path.join(small, t)}.parquet')")
    return c


def rows(spark, sf_dir, name, *columns):
    return sorted(map(tuple, entry.queries()[name](spark, sf_dir).select(*columns).collect()))


def registered(con, name, *columns):
    """Rows of the registered SQL, which selects a part of the table."""
    return set(con.sql(entry.oracle_sql()[name]).select(*columns).fetchall())


def test_expert_sort(spark, small, con):
    every = con.sql("SELECT l_orderkey, l_suppkey % 16 AS expert, row_number() OVER (ORDER BY l_suppkey % 16, l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem")
    assert rows(spark, small, "F15_expert_sort", "place", "expert", "l_orderkey") == sorted(every.select("place", "expert", "l_orderkey").fetchall())


def test_strip(spark, small, con):
    got = rows(spark, small, "J03_strip", "doc_id", "n")
    assert got == sorted((i, len(f"\t {t}\n".strip())) for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall())
    assert registered(con, "J03_strip", "doc_id", "n") <= set(got)


def test_human_time(spark, small, con):
    show = lambda s: f"{s / 3600:.2f}h" if s >= 3600 else f"{s / 60:.2f}m" if s >= 60 else f"{s:.2f}s"
    got = rows(spark, small, "J09_human_time", "o_orderkey", "t")
    assert got == sorted((k, show(c * 7)) for k, c in con.sql("SELECT o_orderkey, o_custkey FROM orders").fetchall())
    assert registered(con, "J09_human_time", "o_orderkey", "t") <= set(got)


def test_human_number(spark, small, con):
    show = lambda x: f"{x / 1e9:.2f}B" if x >= 1e9 else f"{x / 1e6:.2f}M" if x >= 1e6 else f"{x / 1e3:.2f}K" if x >= 1e3 else str(x)
    got = rows(spark, small, "J10_human_number", "o_orderkey", "n")
    assert got == sorted((k, show(c * 7777)) for k, c in con.sql("SELECT o_orderkey, o_custkey FROM orders").fetchall())
    assert registered(con, "J10_human_number", "o_orderkey", "n") <= set(got)


def test_human_number_of_large_keys(spark, tmp_path):
    c = duckdb.connect()
    c.sql("SELECT i::BIGINT AS o_orderkey, i::BIGINT AS o_custkey FROM (VALUES (0), (128), (129), (128584), (128585), (128601), (899999)) t(i)").write_parquet(str(tmp_path / "orders.parquet"))
    c.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet')")
    got = rows(spark, str(tmp_path), "J10_human_number", "o_orderkey", "n")
    assert set(got) == registered(c, "J10_human_number", "o_orderkey", "n") and (128585, "1000.01M") in got
    assert [r.n for r in spark.range(1).select(S.human_number(F.lit(2_500_000_000)).alias("n")).collect()] == ["2.50B"]


def test_label_shift(spark, small, con):
    got = rows(spark, small, "E15_label_shift", "seq_id", "pos", "target", "previous")
    ids = con.sql("SELECT doc_id, list_transform(string_split(text, ' '), lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % 128000) FROM documents").fetchall()
    assert got == sorted((i, p, t[p + 1] if p + 1 < len(t) else 0, t[p - 1] if p else -1) for i, t in ids for p in range(len(t)))
    assert registered(con, "E15_label_shift", "seq_id", "pos", "target", "previous") <= set(got)


def test_lengths(spark, small, con):
    got = rows(spark, small, "H13_lengths", "rollout_id", "prompt_len", "seq_len")
    want = []
    turns = con.sql("SELECT conv_id, list((turn, role, len(string_split(text, ' '))) ORDER BY turn) FROM conversations GROUP BY conv_id").fetchall()
    for conv, messages in turns:
        before, calls = 0, []
        for turn, role, n in messages:
            if role == "assistant":
                prompt = min(before, 3) if conv % 5 == 0 and turn >= 5 else before
                calls.append((prompt, prompt + n))
            before += n
        if calls:
            want.append((conv, calls[0][0], calls[-1][1]))
    assert got == sorted(want)
    assert registered(con, "H13_lengths", "rollout_id", "prompt_len", "seq_len") <= set(got)


def test_errored_rollouts(spark, small, con):
    want = con.sql("SELECT DISTINCT conv_id, conv_id % 11 <> 0 FROM conversations WHERE role = 'assistant'").fetchall()
    assert rows(spark, small, "H05_errored_rollouts_train_nothing", "rollout_id", "trains") == sorted(want)


def plain_selection(buffers, budget):
    """Round robin as in the packer of the trainer, over whole queues of token counts; the number chosen by run."""
    chosen, tokens, at, names = dict.fromkeys(buffers, 0), 0, 0, sorted(buffers)
    while tokens < budget and any(buffers.values()):
        while not buffers[names[at]]:
            at = (at + 1) % len(names)
        run, at = names[at], (at + 1) % len(names)
        while buffers[run]:
            n = buffers[run][0]
            if tokens + n > budget:
                if tokens:
                    return chosen
                buffers[run].pop(0)
                continue
            tokens += n
            chosen[run] += 1
            buffers[run].pop(0)
    return chosen


@pytest.mark.parametrize("most", [90, 200, None])
def test_fair_selection(spark, small, con, tmp_path, most):
    # the first rows of the table leave room for many runs; in the whole table the first run fills the budget
    con.sql(f"SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT {most or 'ALL'}").write_parquet(str(tmp_path / "lineitem.parquet"))
    con.sql("SELECT * FROM orders").write_parquet(str(tmp_path / "orders.parquet"))
    rollouts = con.sql(f"SELECT l_suppkey, 16 + l_partkey % 48 + l_quantity::BIGINT * 20 FROM '{tmp_path}/lineitem.parquet' JOIN orders ON o_orderkey = l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate").fetchall()
    buffers = {}
    for client, n in rollouts:
        buffers.setdefault(f"run_{client}", []).append(n)
    assert len(buffers) > 5
    want = {k: n for k, n in plain_selection(buffers, 65_536).items() if n}
    assert dict(rows(spark, str(tmp_path), "F17_fair_selection", "run", "n")) == want
    assert most is None or any(int(k[4:]) > 5 for k in want)


def test_epoch_shuffle(spark, small, con):
    got = rows(spark, small, "F14_epoch_shuffle", "place", "doc_id")
    ids = [i for (i,) in con.sql("SELECT doc_id FROM documents ORDER BY doc_id").fetchall()]
    assert [p for p, _ in got] == list(range(len(ids)))
    order = [i for _, i in got]
    assert sorted(order) == ids
    assert order != ids
    whole = datasets.shuffled(spark.read.parquet(f"{small}/documents.parquet").select("doc_id").repartition(7), "doc_id", 3)
    assert order == [r.doc_id for r in whole.orderBy("place").collect()]
    assert got == rows(spark, small, "F14_epoch_shuffle", "place", "doc_id")
