"""The network's windows against word-by-word steps, and the registered queries of the learned scores."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolloutframe.llm import pu_quality, queries, toxicity
from rolloutframe.llm._text import slices


def words_of(texts):
    ((_, _, data, offsets),) = slices(pa.array(texts))
    return toxicity.Words(data, offsets)


@pytest.fixture(scope="module")
def fitted():
    r = np.random.default_rng(0)
    texts = [" ".join(f"w{r.integers(0, 60)}" for _ in range(r.integers(1, 90))) for _ in range(400)]
    y = np.arange(400) % 4 == 0
    texts = [t + " idiot moronic w1" if bad else t for t, bad in zip(texts, y, strict=True)]
    return toxicity.fit(texts, y.astype(int))


def step(p, d, x, h):
    k = toxicity.HIDDEN
    g, u = x @ p[f"wx{d}"] + p[f"b{d}"], h @ p[f"wh{d}"]
    z, r = (1 / (1 + np.exp(-(g + u)[i * k : (i + 1) * k])) for i in (0, 1))
    return h + z * (np.tanh(g[2 * k :] + r * u[2 * k :]) - h)


def test_every_overlapping_window_is_scored(fitted):
    net, tables = fitted
    p, s, c = net.p, toxicity.STRETCH, toxicity.CONTEXT
    r = np.random.default_rng(1)
    for n in (0, 1, 31, 32, 33, 64, 65, 150):
        words = words_of([" ".join(r.choice(["idiot", "moronic", "w3", "w7", "New.", "漢"], n)), "other w1 words idiot"])
        top, many = net.highest(words, tables)
        assert many.tolist() == [max(1, n - 31), 1]
        x = np.concatenate([toxicity.pooled(toxicity.Known(words, tables), net.vectors)[words.which], words.shape()], axis=1)[:n]
        states = np.zeros((n, 2 * toxicity.HIDDEN))
        for begin in range(0, n, s):
            h = np.zeros(toxicity.HIDDEN)
            for t in range(max(0, begin - c), min(n, begin + s)):
                h = step(p, "f", x[t], h)
                if t >= begin:
                    states[t, : toxicity.HIDDEN] = h
            h = np.zeros(toxicity.HIDDEN)
            for t in range(min(n, begin + s + c) - 1, begin - 1, -1):
                h = step(p, "b", x[t], h)
                if t < begin + s:
                    states[t, toxicity.HIDDEN :] = h
        best = float(p["bo"]) if not n else -np.inf
        for begin in range(max(1, n - 31) if n else 0):
            own = states[begin : begin + 32]
            w = np.exp(np.tanh(own @ p["wa"] + p["ba"]) @ p["va"])
            best = max(best, float((w / w.sum()) @ own @ p["wo"] + p["bo"]))
        assert top[0] == pytest.approx(best, abs=1e-4)


def test_gradients_by_differences():
    r = np.random.default_rng(1)
    net = toxicity.Network()
    x, mask = r.standard_normal((6, 4, toxicity.INPUTS)).astype(np.float32), np.ones((6, 4), bool)
    mask[4:, 1] = False
    core = mask.copy()
    core[0] = False
    y, w = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        logit = net.forward(x, mask, core)[4].astype(np.float64)
        return float((np.logaddexp(0, logit) - y * logit).mean())

    grad, dx = net.gradients(x, mask, core, y, w)
    places = [(net.p[n], grad[n], tuple(r.integers(0, k) for k in net.p[n].shape)) for n in ("wxf", "whb", "bf", "wa", "va", "wo")]
    places += [(x, dx, tuple(r.integers(0, k) for k in (4, 4, toxicity.INPUTS))) for _ in range(6)]
    for p, g, at in places:
        old, e = p[at], 1e-2
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_gradients_of_the_learned_vectors(fitted):
    net, tables = fitted
    r = np.random.default_rng(2)
    known = toxicity.Known(words_of(["idiot moronic w1 w2 w3 idiotic"]), tables)
    vectors = [v.astype(np.float64) + np.where(np.arange(len(v))[:, None] < len(v) - 1, r.standard_normal(v.shape) * 0.3, 0) for v in net.vectors]
    dx = r.standard_normal((known.n, toxicity.LEARNED))
    own = toxicity.pooled_gradients(known, vectors, toxicity.pooled(known, vectors).astype(np.float32), dx)
    value = lambda: float((toxicity.pooled(known, vectors).astype(np.float64) * dx).sum())
    for i, row in ((0, known.word[0]), (1, known.grams[0][0][0]), (2, known.grams[1][0][0])):
        old = vectors[i][row, 0]
        vectors[i][row, 0] = old + 1e-3
        up = value()
        vectors[i][row, 0] = old - 1e-3
        down = value()
        vectors[i][row, 0] = old
        tie = (toxicity.pooled(known, vectors)[:, 0] == old).sum() > 1
        assert tie or (up - down) / 2e-3 == pytest.approx(own[i][row, 0], abs=0.05)


def test_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(3)
    for true in (0.3, 0.6, 0.9):
        make = lambda n, good: np.where(r.random((n, 1)) < good, 1.5, -1.5) + r.standard_normal((n, 4))
        p, u = make(2000, 1.0), make(4000, true)
        assert pu_quality.estimated_prior(p, u) == pytest.approx(true, abs=0.08)
        net = pu_quality.fit(p, u, true)
        good, bad = make(500, 1.0), make(500, 0.0)
        assert (net.logits(good) > 0).mean() > 0.9
        assert (net.logits(bad) < 0).mean() > (0.9 if true < 0.9 else 0.75)  # a tenth of the unlabelled are bad


@pytest.mark.parametrize(("query", "module", "label", "fold", "out", "cut"), [(queries.op5_toxicity, toxicity, "toxic", 3, 1, 0.7), (queries.op7_pu_quality, pu_quality, "quality", 5, 0, 0.3)])
def test_registered_scores(spark, query, module, label, fold, out, cut):
    where = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in query(spark, where).collect()}
    docs = spark.read.parquet(f"{where}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts)
    model = module.train(docs, spark.read.parquet(f"{where}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % fold != out)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    right = []
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % fold == out)
        assert r.predicted == int(r.score >= cut)
        ((_, _, data, offsets),) = slices(pa.array([texts[i] or ""]))
        alone = model[0].scores(data, offsets, model[1]) if label == "toxic" else model[0].scores(pu_quality.features(data, offsets))
        assert r.score == pytest.approx(float(alone[0]), abs=1e-3)
        if r.held_out and i in labels:
            right.append(r.predicted == labels[i])
    assert np.mean(right) > 0.85


@pytest.mark.parametrize("module", [toxicity, pu_quality])
def test_clashing_and_repeated_columns(spark, module):
    texts = ["you idiot fool"] * 30 + ["a calm and pleasant text"] * 60 + [None, ""]
    rows = [(i if i else 1, t, f"s{i}", i) for i, t in enumerate(texts)] + [(None, "idiot", "x", 0)] + [(5, "idiot", "y", 1)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, _text int")
    labels = spark.createDataFrame([(i, int(i >= 30), int(i < 30), 0.5) for i in range(90)] + [(3, None, None, 0.1), (None, 1, 1, 0.0)], "doc_id long, quality int, toxic int, score double")
    scored = module.score(df, module.train(df, labels, F.lit(True)))
    assert dict(scored.dtypes)["score"] == "double"
    assert scored.count() == len(rows)
    assert module.score(df.where("false"), module.train(df.where("false"), labels, F.lit(True))).count() == 0
