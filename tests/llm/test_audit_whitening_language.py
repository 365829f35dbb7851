"""Divergence audit, whitening and language identification: brute force, held-out accuracy, edge cases."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloutframe.llm import divergence_audit, language_id, queries, whitening

# divergence audit


def audited(rows, least=3, ranks=200):
    """The audit by plain loops over (lang, source, text) rows."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang, holds in docs.items():
        kept = {t for t, d in holds.items() if d >= least}
        groups = {s: Counter({t: n for t, n in c.items() if t in kept}) for (own, s), c in count.items() if own == lang}
        total = sum(groups.values(), Counter())

        def p(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)

        def ranked(part, source, values, most=None):
            for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode())), 1):
                if most is None or rank <= most:
                    out.add((lang, source, part, item, value, rank))

        for s, c in groups.items():
            ranked("pair", s, [(sum((p(c, t) - p(d, t)) ** 2 // p(d, t) for t in kept), o) for o, d in groups.items() if o != s])
            ranked("term", s, [((p(c, t) - p(total, t)) ** 2 // p(total, t), t) for t in kept if c[t] and p(c, t) > p(total, t)], ranks)
    return out


LETTERS = ["the", "The", "ÉTÉ", "été", "é", "a", "b", "c", "漢字", "x1y", "", "7", "don't", "z" * 300]


def some_rows(n, sources, seed=3):
    r = np.random.default_rng(seed)
    return [(r.choice(["en", "de", "", None]), None if i % 17 == 0 else f"s{r.integers(sources)}", None if i % 13 == 0 else " ".join(r.choice(LETTERS, r.integers(0, 9)))) for i in range(n)]


def audit(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, term string")
    got = divergence_audit.divergence(df.repartition(3), **more).collect()
    assert len(set(got)) == len(got)
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got}


def test_audit_equals_plain_loops(spark):
    rows = some_rows(150, 6)
    assert audit(spark, rows) == audited(rows)
    assert audit(spark, rows, ranks=2, least=5) == audited(rows, 5, 2)


def test_audit_in_small_blocks_chunks_and_tables(spark, monkeypatch):
    rows = some_rows(120, 9, 5)
    want = audited(rows)
    monkeypatch.setattr(divergence_audit, "BLOCK", 3)
    assert audit(spark, rows) == want
    # the functions below run in this process: small limits flush within a term
    monkeypatch.setattr(divergence_audit, "CHUNK", 7)
    monkeypatch.setattr(divergence_audit, "HELD", 4)
    kept = [("en", t, 0, 2, g, n) for t, held in (("a", {1: 2, 2: 2, 5: 1}), ("b", {1: 2, 2: 2}), ("c", {2: 9, 5: 1})) for g, n in held.items()]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "tile", "side", "g", "n"), r, strict=True))]) for r in kept]
    cells = Counter()
    for b in divergence_audit._pairs(batches):
        for r in b.to_pylist():
            cells[r["a"], r["b"], r["x"], r["y"]] += r["n"]
    assert cells == Counter({(1, 2, 2, 2): 2, (1, 5, 2, 1): 1, (2, 5, 2, 1): 1, (2, 5, 9, 1): 1})


def test_joint_counts_hold_every_kept_term_once(spark):
    df = spark.createDataFrame(some_rows(150, 6), "lang string, source string, text string")
    kept = divergence_audit.saved(divergence_audit.kept_terms(divergence_audit.counted(df)))
    groups = divergence_audit.saved(divergence_audit.grouped(df, kept))
    cells = divergence_audit.joint_counts(kept, groups).collect()
    assert all(c.n > 0 for c in cells) and any(c.x == c.y == 0 for c in cells)
    v = {r.g: r.v for r in groups.collect()}
    sums = Counter()
    for c in cells:
        sums[c.a, c.b] += c.n
    assert all(n == v[a] == v[b] for (a, b), n in sums.items())


def test_audit_of_few_rows_and_none(spark):
    assert audit(spark, []) == set()
    assert audit(spark, [("en", "a", "x")]) == set()
    rows = [("en", "a", "x"), ("en", "b", None), ("de", "a", "")]
    assert audit(spark, rows) == audited(rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    rows = [("en", "a", "same words " * 2000)] * 4 + [("en", "b", "words")]
    assert audit(spark, rows) == audited(rows)


def test_shares_beyond_longs(spark):
    c = [8_999_999_999, 9_000_000_000, 3 * 10**15]
    df = spark.createDataFrame([(x, x + 7, 11) for x in c], "c long, n long, v long")
    assert [r[0] for r in df.select(divergence_audit.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == [1 + 10**9 * (x + 1) // (x + 18) for x in c]


def test_audit_sql(spark, small):
    from rolloutframe.llm.divergence_audit import ORACLE

    con = duckdb.connect()
    con.execute(f"create view documents as from '{small}/documents.parquet'")
    got = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in queries.op11_divergence_audit(spark, small).collect()}
    assert got == set(con.execute(ORACLE).fetchall())


# whitening


def whitened(spark, vectors, most=32):
    df = spark.createDataFrame([(i, v, i, "x") for i, v in vectors], "vec_id long, embedding array<float>, n long, whitened string")
    return whitening.whiten(df.repartition(3), most).collect()


def held_against(rows, vectors, most=32):
    ids = [i for i, _ in vectors]
    x = np.floor(64 * np.array([np.float32(v) for _, v in vectors]).astype(np.float64)) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    e, v = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > e[0] * 1e-11).sum()))
    assert len(rows) == n * k
    w = {(r.vec_id, r.component): r for r in rows}
    for row in range(n):
        for c in range(k):
            r = w[ids[row], c + 1]
            assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[row], s, strict=True))
            assert r.explained == pytest.approx(e[c] / e.sum(), rel=1e-6)
            assert 0 <= r.identity_error < 1e-8
    for c in range(k):
        if c + 1 < k and e[c] - e[c + 1] < 1e-6 * e[0] or c and e[c - 1] - e[c] < 1e-6 * e[0]:
            continue
        want = (x - s / n) @ v[:, c] / np.sqrt(e[c])
        got = np.array([w[i, c + 1].whitened for i in ids])
        assert min(abs(got - want).max(), abs(got + want).max()) < 1e-6


def test_whitening_equals_eigenvectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((90, 7)) @ r.standard_normal((7, 7)) * [1, 1, 1, 5, 1, 0.3, 1] + 4
    vectors = [(i, list(map(float, v))) for i, v in enumerate(x)]
    held_against(whitened(spark, vectors), vectors)
    held_against(whitened(spark, vectors, 3), vectors, 3)
    # fewer rows than dimensions, and a dimension without spread
    few = [(i, [*v[:6], 1.0]) for i, v in vectors[:5]]
    held_against(whitened(spark, few), few)


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(3)
    good = [(i, list(map(float, v))) for i, v in enumerate(r.standard_normal((20, 3)))]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 0.0]), (55, [1.0, 2.0])]
    held_against(whitened(spark, good + odd), good)
    assert whitened(spark, []) == whitened(spark, odd[:5]) == [] == whitened(spark, good[:1]) == whitened(spark, [(1, [1.0, 2.0])] * 3)
    again = whitened(spark, [*good, (None, good[0][1]), good[0]])
    assert len(again) == 22 * 3 and {x.n for x in again} == {22}
    huge = whitened(spark, [*good, (99, [3e38, 0.0, 0.0])])
    assert all(x.deviation is None for x in huge if x.vec_id == 99) and all(np.isfinite(x.whitened) for x in huge)


def test_triangles_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    r = np.random.default_rng(4)
    vectors = [(i, list(map(float, v))) for i, v in enumerate(r.standard_normal((40, 4)))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(9)
    held_against(whitening.whiten(df).collect(), vectors)


@pytest.mark.parametrize("d", [1, 2, 5, 16])
def test_rotations(d):
    r = np.triu(np.random.default_rng(d).standard_normal((d, d))) * np.logspace(0, -9, d)
    v, length = whitening.jacobi(r)
    assert abs(v.T @ v - np.eye(d)).max() < 1e-12 and (np.diff(length) <= 0).all()
    assert abs(np.linalg.svd(r, compute_uv=False) / length - 1).max() < 1e-6
    a = r @ v / length
    assert abs(a.T @ a - np.eye(d)).max() < 1e-6


# language identification


def test_gradients_by_differences():
    r = np.random.default_rng(1)
    x, y = r.integers(0, 256, (6, language_id.WINDOW)).astype(np.uint8), r.integers(0, 3, 6)
    k = language_id.FILTERS * len(language_id.WIDTHS)
    w = [r.standard_normal((256, language_id.D)), *[r.standard_normal((i, language_id.D, language_id.FILTERS)) / 4 for i in language_id.WIDTHS], r.standard_normal(k), r.standard_normal((k, 3)) / 4, r.standard_normal(3)]

    def loss(w):
        return language_id.gradients(language_id.Network(list("abc"), w[0], w[1:-3], w[-3], w[-2], w[-1]), x, y)

    _, grad = loss(w)
    for i, a in enumerate(w):
        way = r.standard_normal(a.shape)
        step = 2e-3
        up, down = (loss([b + s * step * way if j == i else b for j, b in enumerate(w)])[0] for s in (1, -1))
        assert (up - down) / 2 / step == pytest.approx((grad[i] * way).sum(), rel=0.03, abs=3e-3), i


def test_answers_equal_the_plain_convolution():
    r = np.random.default_rng(2)
    x = r.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    w = [r.standard_normal((i, language_id.D, language_id.FILTERS)) for i in language_id.WIDTHS]
    net = language_id.Network([], r.standard_normal((256, language_id.D)), w, None, None, None).prepared()
    for width, f, got in zip(language_id.WIDTHS, w, net.answers(x), strict=True):
        for t in (0, 17, language_id.WINDOW - width):
            want = sum(net.vectors[x[:, t + j]] @ f[j] for j in range(width))
            assert abs(got[:, t] - want).max() < 1e-4


def test_windows_hold_every_run_of_bytes():
    for n in (0, 1, 3, 4, 252, 253, 256, 257, 509, 510, 5000):
        start, size, text = language_id.windows(np.zeros(n, np.uint8), np.array([0, n]))
        assert (text == 0).all() and len(start) >= 1
        for width in language_id.WIDTHS:
            seen = np.zeros(max(n - width + 1, 0), bool)
            for a, s in zip(start, size, strict=True):
                assert 0 <= s <= language_id.WINDOW and a + s <= n
                seen[a : max(a, a + s - width + 1)] = True
            assert seen.all()


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op13_language_id(spark, sf).collect() if r.held_out and truth[r.doc_id] is not None]
    assert len(got) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in got) > 0.97 * len(got)


def test_language_of_odd_rows(spark):
    words = {"en": "the of and to in is that", "de": "der die und nicht ein mit", "fr": "le la les des une est"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[a].split(), 30)), a) for i, a in enumerate(["en", "de", "fr"] * 20)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 !? 3", "fr"), (None, rows[0][1], "en"), (0, rows[0][1], "de"), (103, "der und " * 60_000, None), (104, rows[0][1], None), (105, "漢字", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "doc_id long, text string, lang string, score string, lang_pred long")
    model = language_id.train(df, F.col("doc_id") < 100)
    assert model.languages == ["de", "en", "fr"]
    out = language_id.predict(df, model)
    assert sorted(out.columns) == ["doc_id", "lang", "lang_pred", "score", "text"]
    got = {(r.doc_id, r.lang): r for r in out.collect()}
    assert sum(got[i, a].lang_pred == a for i, _, a in rows) >= 57
    for i, a in ((100, "en"), (101, "de"), (102, "fr")):
        assert (got[i, a].lang_pred, got[i, a].score) == ("und", 0)
    assert got[103, None].lang_pred == "de" and got[105, None].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in got.values())
    # bit for bit the same alone and in any company
    alone = language_id.predict(df.where("doc_id = 104").coalesce(1), model).first()
    assert alone.score == got[104, None].score == got[None, "en"].score


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert language_id.train(df, F.lit(True)) is None
    assert {(r.lang_pred, r.score) for r in language_id.predict(df, None).collect()} == {("und", 0.0)}
    assert language_id.predict(df.limit(0), None).collect() == []
    one = spark.createDataFrame([(1, "text", "xx")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.predict(one, language_id.train(one, F.lit(True))).collect()] == [("xx", 1.0)]
