"""Chat formatting of reply trees.

A tree is a set of messages that name the message they reply to. Pointer doubling by iterative self-joins on
(tree, parent) enumerates the root-to-leaf paths: after round r every message knows its ancestor 2**r steps up and what
the scores on the way there sum to, so a tree of depth d takes log2(d) rounds. Branches rank by mean score, ties to the
smaller leaf key. The chosen leaves then gather their paths through the same pointers, and one shuffle of the texts by
path formats each as one conversation. The self-joins carry ids and scores only.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Escaping puts a backslash after every ``<``, ``[`` and
backslash of a role or text, so that no control string of this or another template survives inside them; unescaping
drops the character after each of the three. A line break in a role is written as ``[n``, which no escaped text holds. The loss mask covers the escaped texts of the assistant's turns.

Edge cases: a null text or role is empty; a message whose parent is missing is a root; messages on a cycle have no root
and belong to no path; repeated rows are messages of their own; a null tree id is a tree of its own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import delete, saved

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def escape(c):
    return F.regexp_replace(c, r"([<\[\\])", "$1\\\\")


def unescape(c):
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def reply_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, distance): the messages of the ``best`` best root-to-leaf paths of each tree.

    ``nodes``: tree, node (unique in its tree), parent (null for a root), score. distance counts from the leaf.
    """
    key = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    n = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = n.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    n = n.join(known, key("tree", "t") & (F.col("parent") == F.col("p")), "left").select("tree", "node", F.col("p").alias("up"), "score", F.lit(1).cast("long").alias("steps"))
    # levels[r]: messages with an ancestor 2**r steps up, their scores up to there; done: what has reached a root
    first = saved(n)
    levels, done = [first.where("up is not null")], first.where("up is null")
    leaves = first.select("tree", "node").join(levels[0].select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct(), key("tree", "t") & (F.col("node") == F.col("p")), "left_anti")
    rows, tables = first.count(), [first]
    while levels[-1].limit(1).count() and 1 << (len(levels) - 1) <= rows:
        a = levels[-1]
        b = a.unionByName(done).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("steps").alias("k2"))
        a = a.join(b, key("tree", "t") & (F.col("up") == F.col("n")))
        tables.append(saved(a.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("steps") + F.col("k2")).alias("steps"))))
        levels.append(tables[-1].where("up is not null"))
        done = done.unionByName(tables[-1].where("up is null"))
    ranked = leaves.alias("l").join(done.alias("r"), F.col("l.tree").eqNullSafe(F.col("r.tree")) & (F.col("l.node") == F.col("r.node"))).select("l.tree", "l.node", (F.col("score") / F.col("steps")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    path = ranked.withColumn("rank", rank).where(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("distance"))
    for r in range(len(levels) - 1, -1, -1):
        b = levels[r].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        # each message stays and brings its ancestor 2**r steps up; one reference to path keeps the plan linear
        both = F.array(F.struct("node", "distance"), F.struct(F.col("up").alias("node"), (F.col("distance") + (1 << r)).alias("distance")))
        path = path.join(b, key("tree", "t") & (F.col("node") == F.col("n")), "left").select("tree", "leaf", "rank", F.explode(both).alias("x")).select("tree", "leaf", "rank", "x.node", "x.distance").where("node is not null")
    out = saved(path)
    for x in tables:
        delete(x)
    return out


def format_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss_spans): ``loss_spans`` are (start, length) in code points.

    ``nodes``: tree, node, parent, score, role, text.
    """
    path = reply_paths(nodes, best)
    text = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("[n")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    turns = path.join(text, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    # the longest distance is the root's, so the first turn
    got = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "role", "text"))).alias("x"))
    head = F.length(F.lit(BEGIN)) + 1
    whole = lambda x: head + F.length(x["role"]) + F.length(x["text"]) + len(END)
    start = lambda acc, x: F.struct((acc["end"] + whole(x)).alias("end"), F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["end"] + head + F.length(x["role"])).alias("start"), F.length(x["text"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"))
    none = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    formatted = F.array_join(F.transform("x", lambda x: F.concat(F.lit(BEGIN), x["role"], F.lit("\n"), x["text"], F.lit(END))), "")
    return got.select("tree", "leaf", "rank", F.size("x").cast("long").alias("n_turns"), formatted.alias("formatted"), F.aggregate("x", none, start)["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (role and text of each, unescaped) and loss (all text under the mask, unescaped)."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    cut = lambda x: F.struct(unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("[n"), F.lit("\n"))).alias("role"), unescape(F.substring(x, F.instr(x, F.lit("\n")) + 1, F.length(x) - F.instr(x, F.lit("\n")) - len(END))).alias("text"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("turns", F.transform(parts, cut)).withColumn("loss", loss)


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each turn replies to the one before (ties by role, then text)."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select("conv_id", "turn", "role", "text").withColumn("node", at.cast("long")).select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
