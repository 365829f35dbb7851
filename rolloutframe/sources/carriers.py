"""Rollout-shaped views over the test tables.

Each view exists twice: as SQL text that Spark and DuckDB both run (``VIEWS``), which keeps the two sides of a check on the
same rows, and as a DataFrame through ``view``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"

ROLLOUTS = f"""
SELECT o.o_orderpriority AS env_name, l.l_orderkey AS example_id,
  CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {ORDER}) - 1 AS BIGINT) AS rollout_idx,
  CASE WHEN l.l_quantity > 25 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS reward_bin,
  l.l_quantity / CAST(50 AS DOUBLE) AS reward,
  CAST(l.l_quantity AS BIGINT) * 20 AS completion_len, 16 + l.l_partkey % 48 AS prompt_len,
  l.l_linestatus = 'F' AS is_truncated,
  CASE l.l_returnflag WHEN 'A' THEN 'prompt_too_long' WHEN 'R' THEN 'max_turns' ELSE NULL END AS stop_condition,
  l.l_extendedprice / CAST(10 AS DOUBLE) AS generation_ms, l.l_discount * CAST(1000 AS DOUBLE) AS scoring_ms, CAST(l.l_linenumber AS BIGINT) AS version,
  l.l_suppkey AS client, o.o_orderstatus AS task, l.l_extendedprice AS price
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

GROUPS4 = """
SELECT * FROM (SELECT r.*, count(*) OVER (PARTITION BY example_id) AS group_size FROM rollouts r) g WHERE group_size >= 4 AND rollout_idx < 4
"""

PART, SMALL = 8 << 20, 1 << 20  # bytes of a table's files for a task
ROWS = 1 << 18  # most rows for a task
READ = 1 << 20  # most rows of files for a task that reads
SPLIT = "spark.sql.files.maxPartitionBytes"

VIEWS = {"rollouts": ROLLOUTS, "groups4": GROUPS4}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables and of the rollout-shaped views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extent(rows: DataFrame) -> tuple[int, int]:
    """Bytes of a table's files and its rows, which are counted from the footers of the files."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), rows.count()


def dealt(spark: SparkSession, size: int, rows: int) -> int:
    """Tasks to deal a table to: each gets PART bytes of its files, or a part of SMALL where there are fewer than the session
    runs at once, and no more than ROWS rows, which files that compress well hold in few bytes."""
    return max(-(-size // PART), -(-rows // ROWS), min(-(-size // SMALL), spark.sparkContext.defaultParallelism), 1)


def parts(spark: SparkSession, rows: DataFrame) -> int:
    """Tasks to deal a table's rows to."""
    return dealt(spark, *extent(rows))


def bounded_reads(spark: SparkSession, size: int, rows: int) -> None:
    """No task of the session reads more bytes of files than READ rows of this table take; a smaller setting stays.

    Beyond 200 parts (spark.shuffle.sort.bypassMergeThreshold) a shuffle's writer sorts what its task has read in memory. A
    task still reads a whole row group, however large.
    """
    most = max(size * READ // max(rows, 1), SMALL)
    if most < spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        spark.conf.set(SPLIT, f"{most}b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rollout-shaped view as a DataFrame.

    Both tables are dealt by the order into as many parts as the larger one's files ask for; the join, the numbering and
    every later step by example stay in these parts. So a task sorts as many rows however large the tables are: where
    Spark merges partitions by their compressed bytes, rows that compress well make tasks of many more rows. Tasks that read
    the files are bounded by rows too.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    size, rows = extent(lines)
    n = dealt(spark, size, rows)
    bounded_reads(spark, size, rows)
    lines.repartition(n, "l_orderkey").createOrReplaceTempView("lineitem")
    orders.repartition(n, "o_orderkey").createOrReplaceTempView("orders")
    spark.sql(ROLLOUTS).createOrReplaceTempView("rollouts")
    return spark.table("rollouts") if name == "rollouts" else spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB, with the named views in front."""
    need = ["rollouts", *[n for n in names if n != "rollouts"]]
    body = sql.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
