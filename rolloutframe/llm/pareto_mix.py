"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh as a repeating cycle says and share a budget; no target exceeds
``most`` times its source's size, and what that cuts off is shared again by weight until none is above. Sorting sources
by size over weight turns this into one prefix sum.

Copies: within a source a document of 2**b to 2**(b+1) - 1 words has the weight b + 1, and its expected copies are
proportional to that, at most ``most``, and such that the source's expected words equal its target. The whole part of
the expected copies is certain. The fraction p is the inclusion probability of one more copy: with a random u from a
hash of the id, documents rank by (u / (1 - u)) / (p / (1 - p)) (Pareto order sampling), and the first ones are taken
whose sizes come nearest to the words that the whole copies leave open.

Scale: a (source, band) table is all that is solved for, and it has at most 32 rows for each source. The cut in a
source's ranking is found through sums over 4096 ranges of the rank variable; only documents in the range that holds
the cut are ordered one by one.

Edge cases: a null text has size 0; documents of size 0 take nothing; a null source is a source of its own; repeated
rows with one id rank alike and are ordered by size; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 4096
MANY_SOURCES = 100_000  # (source, band) rows up to which the solved table is broadcast: a few MB


def pareto_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep=()) -> DataFrame:
    """id, size, source_size, target, copies, taken and the columns of ``keep`` for every document."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    d = d.withColumn("_band", F.when(F.col("size") > 0, F.length(F.conv(F.col("size").cast("string"), 10, 2))).otherwise(F.lit(0)))
    d = saved(d)  # the texts are read once; each pass below reads the columns that it needs
    # a table of sources and bands: bounded by the sources, not by the rows
    bands = d.groupBy("_source", "_band").agg(F.sum("size").alias("s")).withColumn("_band", F.col("_band").cast("double"))
    sources = bands.groupBy("_source").agg(F.sum("s").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("i", F.row_number().over(one.orderBy(F.col("_source").isNull(), F.col("_source"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("i"), F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = one.orderBy(F.col("cap") / F.col("w"), "i")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # all sources before this one are full; this one too, if its part of the rest is above its cap
    sources = (
        sources.withColumn("budget", F.sum("source_size").over(one) * F.lit(share))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("part", F.col("left") * F.col("w") / F.col("open"))
        .withColumn("full", F.col("part") >= F.col("cap"))
        .withColumn("first", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("i"), F.col("left"), F.col("open")))).over(one))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("first.left") * F.col("w") / F.col("first.open")))
    ).select("_source", "source_size", "target")
    # expected copies of a band: min(most, c * band), found in the same way over the bands, which fill from the top
    b = bands.join(sources, bands["_source"].eqNullSafe(sources["_source"])).drop(sources["_source"]).where("_band > 0")
    mine = Window.partitionBy("_source")
    above = mine.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    b = (
        b.withColumn("left", F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("s").over(above), F.lit(0)))
        .withColumn("load", F.sum(F.col("_band") * F.col("s")).over(mine) - F.coalesce(F.sum(F.col("_band") * F.col("s")).over(above), F.lit(0.0)))
        .withColumn("c", F.col("left") / F.col("load"))
        .withColumn("full", F.col("c") * F.col("_band") >= most)
        .withColumn("open_c", F.max(F.when(~F.col("full"), F.struct("_band", "c"))).over(mine)["c"])
        .withColumn("expected", F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.col("open_c") * F.col("_band"), F.lit(float(most)))))
        .withColumn("whole", F.floor(F.col("expected") + 1e-12))
        .withColumn("p", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
        .withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("s")).over(mine))
    )
    solved = bands.join(sources, bands["_source"].eqNullSafe(sources["_source"]), "left").drop(sources["_source"]).select("_source", "_band", "source_size", "target")
    b = b.select(F.col("_source").alias("_s"), F.col("_band").alias("_b"), "whole", "p", "rest")
    solved = solved.join(b, solved["_source"].eqNullSafe(b["_s"]) & (solved["_band"] == b["_b"]), "left").select(F.col("_source").alias("_s"), F.col("_band").cast("int").alias("_b"), "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("rest", F.lit(0.0)).alias("rest"))
    solved = saved(solved)  # sources times bands
    few = solved.count() <= MANY_SOURCES
    if few:
        solved = F.broadcast(solved)
    d = d.join(solved, d["_source"].eqNullSafe(solved["_s"]) & (d["_band"] == solved["_b"]), "left").drop("_s", "_b")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    d = d.withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    d = d.withColumn("range", F.when(F.col("q").isNotNull(), F.floor(F.col("q") / (1 + F.col("q")) * RANGES).cast("int")))
    # which range of each source holds the cut, and what the ranges before it sum to
    sums = d.where("range is not null").groupBy("_source", "range").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
    upto = F.sum("s").over(mine.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    cut = sums.withColumn("done", F.coalesce(upto, F.lit(0))).where("done < rest").groupBy("_source").agg(F.max(F.struct("range", "done")).alias("x")).select(F.col("_source").alias("_s"), F.col("x.range").alias("cut"), F.col("x.done").alias("done"))
    if few:
        cut = F.broadcast(cut)
    d = d.join(cut, d["_source"].eqNullSafe(cut["_s"]), "left").drop("_s")
    edge = F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
    inside = d.where(edge)
    order = Window.partitionBy("_source").orderBy("q", "_id", "size")
    inside = inside.withColumn("sum", F.col("done") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest, total, last = F.col("rest"), F.col("sum"), F.col("sum") - F.col("size")
    # the longest prefix within the rest, and one more document where that is nearer
    inside = inside.withColumn("more", ((total <= rest) | ((last < rest) & (total - rest <= rest - last))).cast("int")).drop("sum")
    outside = d.where(~edge).withColumn("more", F.coalesce(F.col("range") < F.col("cut"), F.lit(False)).cast("int"))
    out = inside.unionByName(outside)
    copies = (F.coalesce(F.col("whole"), F.lit(0)) + F.col("more")).cast("long")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN floor(log2(size::DOUBLE) + 1e-9)::INT + 1 ELSE 0 END AS band FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM e GROUP BY source),
sw AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
sl AS (SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_all,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM sw),
sf AS (SELECT *, rest_all * w / open >= cap AS is_full FROM sl),
st AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
  (SELECT x.rest_all / x.open FROM sf x WHERE NOT x.is_full ORDER BY x.cap / x.w, x.i LIMIT 1) * w END AS target FROM sf),
b AS (SELECT e.source, e.band::DOUBLE AS band, sum(e.size)::DOUBLE AS s, any_value(st.target) AS target FROM e JOIN st ON e.source IS NOT DISTINCT FROM st.source WHERE e.band > 0 GROUP BY e.source, e.band),
bl AS (SELECT *, target - 2.0::DOUBLE * coalesce(sum(s) OVER (PARTITION BY source ORDER BY band DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_all,
  sum(band * s) OVER (PARTITION BY source) - coalesce(sum(band * s) OVER (PARTITION BY source ORDER BY band DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS load FROM b),
bf AS (SELECT *, rest_all / load AS c, (rest_all / load) * band >= 2 AS is_full FROM bl),
bo AS (SELECT *, max(CASE WHEN NOT is_full THEN band END) OVER (PARTITION BY source) AS top FROM bf),
bc AS (SELECT *, max(CASE WHEN band = top THEN c END) OVER (PARTITION BY source) AS open_c FROM bo),
bw AS (SELECT *, CASE WHEN is_full THEN 2.0::DOUBLE ELSE least(open_c * band, 2.0::DOUBLE) END AS expected FROM bc),
bp AS (SELECT *, floor(expected + 1e-12) AS whole, greatest(expected - floor(expected + 1e-12), 0.0) AS p FROM bw),
br AS (SELECT *, target - sum(whole * s) OVER (PARTITION BY source) AS rest FROM bp),
u AS (SELECT e.*, st.source_size, st.target, br.whole, br.p, br.rest,
  (('0x' || substr(md5('mix' || coalesce(e.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM e JOIN st ON e.source IS NOT DISTINCT FROM st.source LEFT JOIN br ON e.source IS NOT DISTINCT FROM br.source AND e.band = br.band),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM q WHERE q IS NOT NULL),
m AS (SELECT doc_id, size, source_size, target, (whole + CASE WHEN total <= rest OR (total - size < rest AND total - rest <= rest - (total - size)) THEN 1 ELSE 0 END) AS copies FROM r
  UNION ALL SELECT doc_id, size, source_size, target, coalesce(whole, 0) FROM q WHERE q IS NULL)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM m
"""
