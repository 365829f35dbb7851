"""Source divergence audit by joint count histograms.

Terms are runs of letters (A-Z and a-z, lower-cased) and of everything beyond ASCII. A language keeps the terms that at
least ``least`` of its documents hold. In a (language, source) group a kept term of count c has the share
p(c) = 1 + floor(SCALE * (c + 1) / (N + V)), N being the group's occurrences of kept terms and V the number of kept
terms; a language's own share q of a term is made in the same way from its own counts. The divergence of a share p from
a share q is f = floor((p - q) * (p - q) / q), in whole numbers throughout.

A pair of sources is compared through its joint histogram: the number of kept terms for each (count here, count there).
Terms that both hold are tallied from the sorted counts of each term; the cells with a zero are implied: terms that one
source holds c times, less those of them that the other holds as well, and for both zeros what is left of V. f is
evaluated once for each cell, both ways, and counts as often as the cell says.

Scale: tasks tally (source, term) over all their texts before anything is shuffled, in tables of at most HELD rows.
Counts are then summed by (language, term, source), and a term's rows, one for each source at most, meet by (language,
term). For the joint histograms sources are dealt to blocks of BLOCK, and a term's rows go to each tile of two blocks, so
that no task meets more than two blocks of one term; of up to BLOCK sources there is one tile and no copy. The result has
a row for each ordered pair of sources of a language, so its size is the square of their number, whatever the method.

Edge cases: null text, language and source are ''; every row is a document, repeated ids or not; a group without terms
has N = 0 and takes part in pairs; a language without kept terms has pairs of value 0; a source alone in its language
has no pairs; ties go by the item's UTF-8 bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches, saved
from ._text import LOWER, slices, spans

SCALE = 1_000_000_000
HELD = 1 << 19  # rows of tallies that a task holds: about 30 MB
BLOCK = 256  # sources
CHUNK = 1 << 16  # rows whose pairs are tallied together
LONG_SAFE = 9_000_000_000  # counts up to which SCALE * (count + 1) is a long

NOT_TERM = np.ones(256, bool)
for _r in (range(65, 91), range(97, 123), range(128, 256)):
    NOT_TERM[list(_r)] = False


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, their texts) of a slice, every occurrence."""
    starts, ends, doc = spans(data, offsets, NOT_TERM)
    inside = LOWER[data[~NOT_TERM[data]]]
    ends = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(inside)), doc


def tallies(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> pa.Table:
    """g, term, n (occurrences) and d (texts that hold it) of a slice; ``group``: of each text."""
    terms, doc = words(data, offsets)
    coded = terms.dictionary_encode()
    many = max(1, len(coded.dictionary))
    own, n = np.unique(doc * many + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    key, which, d = np.unique(group[own // many] * many + own % many, return_inverse=True, return_counts=True)
    n = np.bincount(which, n, len(key)).astype(np.int64)
    return pa.table({"g": key // many, "term": coded.dictionary.take(pa.array(key % many)), "n": n, "d": d})


def _summed(held: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n", "sum"), ("d", "sum")])
    return t.rename_columns(["g", "term", "n", "d"])


def counted(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, d: sums over the texts of a task, so a key comes once for each task or flush."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches):
        groups: dict[tuple[str, str], int] = {}
        held, size = [], 0

        def out(t: pa.Table):
            names = list(groups)
            g = t.column("g").to_numpy()
            lang, source = (pa.array([x[i] for x in names]).take(pa.array(g)) for i in (0, 1))
            return pa.table([lang, source, t.column("term").cast(pa.string()), t.column("n"), t.column("d")], names=["lang", "source", "term", "n", "d"]).to_batches(CHUNK)

        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            group = np.array([groups.setdefault(x, len(groups)) for x in pairs], np.int64)
            for lo, hi, data, offsets in slices(batch.column(2)):
                t = tallies(data, offsets, group[lo:hi])
                held.append(t)
                size += len(t)
                if size > HELD:
                    held = [_summed(held)]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield from out(held[0])
                        held, size = [], 0
        if size:
            yield from out(_summed(held))

    return rows.mapInArrow(run, "lang string, source string, term string, n long, d long")


def kept_terms(counts: DataFrame, least: int = 3) -> DataFrame:
    """lang, term, source, n, total (the language's occurrences), lead (1 on one row of each of a language's terms)."""
    c = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    c = c.select("*", F.sum("d").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.col("source") == F.min("source").over(term)).cast("long").alias("lead"))
    return c.where(F.col("docs") >= least).select("lang", "term", "source", "n", "total", "lead")


def grouped(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, g, place (of the source in its language), v, n (the group's occurrences) and total (the language's)."""
    every = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("lead").alias("lead"))
    lang, zero = Window.partitionBy("lang"), F.lit(0).cast("long")
    out = every.join(own, ["lang", "source"], "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "lead")])
    out = out.select("lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("place"), F.sum("lead").over(lang).alias("v"), "n", F.sum("n").over(lang).alias("total"))
    return out.withColumn("g", F.monotonically_increasing_id())


def _packed(a, b, x, y, n):
    """The cells (a, b, x, y) once each, with the sums of n."""
    order = np.lexsort((y, x, b, a))
    a, b, x, y, n = (c[order] for c in (a, b, x, y, n))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], x[at], y[at], np.add.reduceat(n, at) if len(at) else n


def _pairs(batches):
    """Tallies of the pairs of groups that share a term; rows lang, term, tile, side, g, n in the order of the first three."""
    held, size = [], 0

    def ready():
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if len(rest) >= CHUNK:
                rest = rest.combine_chunks()
                key = runs(rest)
                cut = int(np.searchsorted(key, key[-1]))  # the last term may go on in the next batch
                yield key[:cut], rest.slice(0, cut)
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            rest = rest.combine_chunks()
            yield runs(rest), rest

    def runs(t):
        """The number of the run of equal keys that each row is in."""
        new = np.zeros(len(t), bool)
        for c in ("lang", "term", "tile"):
            column = t.column(c)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(t) - 1)).to_numpy()
        return np.cumsum(new)

    def cells(key, t):
        side, g, n = (t.column(c).to_numpy() for c in ("side", "g", "n"))
        for step in range(1, len(key)):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                return
            # a tile of two blocks holds the pairs across them, one of a single block (side 2) its own
            same = same[(side[same] != side[same + step]) | (side[same] == 2)]
            swap = g[same] > g[same + step]
            i, j = np.where(swap, same + step, same), np.where(swap, same, same + step)
            yield g[i], g[j], n[i], n[j], np.ones(len(i), np.int64)

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "x", "y", "n"])

    for key, t in ready():
        for got in cells(key, t):
            held.append(got)
            size += len(got[0])
            if size > HELD:
                held = [_packed(*[np.concatenate(c) for c in zip(*held, strict=True)])]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(_packed(*[np.concatenate(c) for c in zip(*held, strict=True)]))


def joint_counts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, x, y, n: the n kept terms of their language that the group a holds x times and b y times, zeros included."""
    blocks = groups.groupBy("lang").agg((F.floor(F.max("place") / BLOCK) + 1).cast("int").alias("blocks"))
    place = groups.join(blocks, "lang").select("lang", "source", "g", F.floor(F.col("place") / BLOCK).cast("int").alias("block"), "blocks")
    rows = kept.select("lang", "source", "term", "n").join(place, ["lang", "source"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("lang", "term", "g", "n", "block", "blocks", other.alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
    rows = rows.select("lang", "term", (low.cast("long") * F.col("blocks") + high).alias("tile"), side.alias("side"), "g", "n")
    met = rows.repartition("lang", "term", "tile").sortWithinPartitions("lang", "term", "tile").mapInArrow(_pairs, "a long, b long, x long, y long, n long")
    met = saved(met.groupBy("a", "b", "x", "y").agg(F.sum("n").alias("n")))
    zero = F.lit(0).cast("long")

    def cell(x, y, n) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), n.alias("n"))

    x, y, n = F.col("x"), F.col("y"), F.col("n")
    shared = met.select("a", "b", F.inline(F.array(cell(x, y, n), cell(x, zero, -n), cell(zero, y, -n), cell(zero, zero, n))))
    # the distinct counts of a group, with every other source of the language
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups.select("lang", "source", "g"), ["lang", "source"]).select("lang", "g", F.col("n").alias("c"), "terms")
    there = groups.select("lang", F.col("g").alias("h"))
    alone = own.join(there, "lang").where("g <> h")
    c, t, first = F.col("c"), F.col("terms"), F.col("g") < F.col("h")
    alone = alone.select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), F.inline(F.array(cell(F.when(first, c).otherwise(zero), F.when(first, zero).otherwise(c), t), cell(zero, zero, -t))))
    none = groups.select("lang", F.col("g").alias("a"), F.col("v").alias("n")).join(there, "lang").where("a < h").select("a", F.col("h").alias("b"), zero.alias("x"), zero.alias("y"), "n")
    return shared.unionByName(alone).unionByName(none).groupBy("a", "b", "x", "y").agg(F.sum("n").alias("n")).where("n <> 0")


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), exact for every long."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))
    return 1 + F.when(count < LONG_SAFE, _div(F.lit(SCALE).cast("long") * (count + 1), total + v)).otherwise(_div(*wide))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = 3, ranks: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' for each other source, part 'term' for the first ``ranks`` terms."""
    kept = saved(kept_terms(counted(docs, lang_col, source_col, text_col), least))
    groups = saved(grouped(docs, kept, lang_col, source_col))
    g = groups.select("g", "lang", "source", "n", "v")
    cells = joint_counts(kept, groups)
    a, b = (g.select(*[F.col(c).alias(f"{c}_{s}") for c in g.columns]) for s in "ab")
    cells = cells.withColumnRenamed("n", "terms").join(a, F.col("a") == F.col("g_a")).join(b, F.col("b") == F.col("g_b"))
    p, q = share(F.col("x"), F.col("n_a"), F.col("v_a")), share(F.col("y"), F.col("n_b"), F.col("v_b"))
    cells = cells.withColumn("p", p).withColumn("q", q)
    both = cells.groupBy("a", "b").agg(F.sum(apart(F.col("p"), F.col("q")) * F.col("terms")).alias("there"), F.sum(apart(F.col("q"), F.col("p")) * F.col("terms")).alias("back"))
    # pairs of a language without kept terms have no cells
    empty = groups.where("v = 0").select("lang", F.col("g").alias("a"))
    empty = empty.join(empty.select("lang", F.col("a").alias("b")), "lang").where("a < b").select("a", "b", F.lit(0).cast("long").alias("there"), F.lit(0).cast("long").alias("back"))
    pairs = both.unionByName(empty).select(F.inline(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("h"), F.col("there").alias("value")), F.struct(F.col("b").alias("g"), F.col("a").alias("h"), F.col("back").alias("value")))))
    pairs = pairs.join(g.select("g", "lang", "source"), "g").join(g.select(F.col("g").alias("h"), F.col("source").alias("item")), "h").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = kept.join(groups.select("lang", "source", "v", F.col("n").alias("n_group"), F.col("total").alias("n_lang")), ["lang", "source"])
    terms = terms.withColumn("p", share(F.col("n"), F.col("n_group"), F.col("v"))).withColumn("q", share(F.col("total"), F.col("n_lang"), F.col("v"))).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    first = terms.withColumn("rank", order).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", order).unionByName(first)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*)::BIGINT AS n FROM t JOIN k USING (lang, term) GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, (SELECT count(*) FROM k WHERE k.lang = g.lang)::HUGEINT AS v, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source)::HUGEINT AS n,
  (SELECT coalesce(sum(total), 0) FROM k WHERE k.lang = g.lang)::HUGEINT AS n_lang FROM g),
p AS (SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (m.n + m.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (m.n_lang + m.v) AS q
  FROM m JOIN k ON k.lang = m.lang LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
