"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is web text of the same corpus, labels unseen. The
model, a network with one hidden layer over document statistics, minimises the non-negative unbiased risk
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with the logistic loss; where a batch's second term falls below zero, the step
goes against it. Labels of bad documents serve nothing at all.

The class prior pi, the share of good documents among the unlabelled, is estimated from the two samples alone. A network
that tells positives from unlabelled ones is fitted on one half of both. On the other half, the share of the unlabelled
that score at least c over the share of the positives that do is an upper bound of pi for every c, and near it where only
good documents score so high; the estimate is the ratio at the c whose upper confidence bound is the least.

Statistics of a whole text: frequencies of neighbouring byte classes, repeated neighbours, distinct words, the most
frequent word's share, lengths. Fitting takes bounded samples (POSITIVES and UNLABELLED rows by hash of the id) and runs
on the driver; scoring is one pass without a shuffle and covers every row.

Edge cases: null and empty texts have statistics of zero and a score like any; without a positive or an unlabelled
document to learn from, every score is 0.5; several labels of one id count once each; of repeated rows of an id the least
text is learned from; rows with a null id are scored and never learned from; repeated rows score alike; other columns
stay, but one named like the score is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._text import GOLDEN, LOWER, U64, mix64, range_hashes, slices, spans

POSITIVES, UNLABELLED = 6_000, 8_000
HIDDEN, EPOCHS, BATCH, RATE = 16, 40, 2048, 3e-3

# byte classes: lower, upper, digit, blank, line break, stops, quotes and hyphen, other signs, bars and brackets, !, beyond ASCII, control
CLASS = np.full(256, 11, np.intp)
for _i, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:", b"'\"-", b"#$%&*+/=?@\\^_`~", b"|()<>[]{}", b"!", range(128, 256))):
    CLASS[list(_bytes)] = _i
N_CLASS = 12
FEATURES = N_CLASS * N_CLASS + 7


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text of a slice, one row each."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    size = np.diff(offsets)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    c = CLASS[data]
    pair = np.bincount(doc[:-1][doc[:-1] == doc[1:]] * N_CLASS**2 + (c[:-1] * N_CLASS + c[1:])[doc[:-1] == doc[1:]], minlength=n * N_CLASS**2).reshape(n, -1)
    out[:, : N_CLASS**2] = np.sqrt(pair / np.maximum(size - 1, 1)[:, None])
    starts, ends, word_doc = spans(data, offsets)
    words = range_hashes(LOWER[data], starts, ends)
    count = np.bincount(word_doc, minlength=n)
    safe = np.maximum(count, 1)
    same = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
    with np.errstate(over="ignore"):
        key, first, many = np.unique(mix64(words + word_doc.astype(U64) * GOLDEN), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, word_doc[first], many)
    more = (np.log1p(count), np.log1p(size), np.bincount(word_doc, ends - starts, n) / safe / 10, np.bincount(word_doc[1:][same], minlength=n) / safe, np.bincount(word_doc[first], minlength=n) / safe, top / safe, np.bincount(word_doc[first], many > 1, n) / safe)
    out[:, N_CLASS**2 :] = np.column_stack(more)
    return out


class Network:
    """tanh layer and one output, fitted by Adam."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -40, 40)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 4, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the two samples."""
    rng = np.random.default_rng(seed)
    halves = []
    for x in (positive, unlabelled):
        order = rng.permutation(len(x))
        halves.append((x[order[: (len(x) + 1) // 2]], x[order[len(x) // 2 :]]))
    (p, p_rest), (u, u_rest) = halves
    apart = fit(p, u, 0.5, seed, unbiased=False)
    at_p, at_u = np.sort(apart.logits(p_rest)), np.sort(apart.logits(u_rest))
    cut = np.unique(np.concatenate([at_p, at_u]))
    share_p, share_u = (1 - np.searchsorted(x, cut, "left") / len(x) for x in (at_p, at_u))
    slack = np.sqrt(np.log(4 / doubt) / 2 / len(p_rest)) + np.sqrt(np.log(4 / doubt) / 2 / len(u_rest))
    some = share_p > 0
    best = np.argmin((share_u[some] + slack) / share_p[some])
    return float(np.clip(share_u[some][best] / share_p[some][best], 0.01, 0.99))


PENALTY = 1e-4  # of squared weights


def gradient(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float, unbiased: bool = True) -> list[np.ndarray]:
    """Gradient of the risk of a batch of positives p and unlabelled u, by each part of w; against the step where the
    unlabelled part of the risk is negative."""
    x = np.concatenate([p, u])
    h = np.tanh(x @ w[0] + w[1])
    g = h @ w[2] + w[3]
    up = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # derivative of l(-); that of l(+) is up - 1
    gp, gu = g[: len(p)], g[len(p) :]
    rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    if not unbiased:
        dg = np.concatenate([(up[: len(p)] - 1) / len(p), up[len(p) :] / len(u)]) / 2
    elif rest >= 0:
        dg = np.concatenate([prior * (up[: len(p)] - 1) / len(p) - prior * up[: len(p)] / len(p), up[len(p) :] / len(u)])
    else:
        dg = np.concatenate([prior * up[: len(p)] / len(p), -up[len(p) :] / len(u)])
    dh = np.outer(dg, w[2]) * (1 - h * h)
    return [x.T @ dh + PENALTY * w[0], dh.sum(axis=0), h.T @ dg + PENALTY * w[2], dg.sum()]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3, unbiased: bool = True) -> Network:
    """Minimise the non-negative risk. Logistic loss: l(+) = log(1 + e**-g), l(-) = log(1 + e**g).

    Without ``unbiased`` the unlabelled are taken for negatives: the network tells the two samples apart.
    """
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-2
    d = unlabelled.shape[1]
    w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.array(np.log(prior / (1 - prior)))]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    z = [np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled)]
    steps = max(1, len(unlabelled) // BATCH)
    for _ in range(max(EPOCHS, 400 // steps)):
        order = [rng.permutation(len(x)) for x in z]
        for s in range(steps):
            p, u = (x[o[np.arange(s * BATCH, (s + 1) * BATCH) % len(o)]] for x, o in zip(z, order, strict=True))
            grad = gradient(w, p, u, prior, unbiased)
            t += 1
            for i, a in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * a
                v[i] = 0.999 * v[i] + 0.001 * a * a
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean.astype(np.float32), scale.astype(np.float32), w[0].astype(np.float32), w[1].astype(np.float32), w[2].astype(np.float32), float(w[3]))


def sampled(rows: DataFrame, count: int, most: int, id_col: str) -> DataFrame:
    """About ``most`` of ``count`` rows, by a hash of the id."""
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * most / count))


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """The least text of each key: an id of many rows is brought down to one before anything is collected."""
    return rows.groupBy(*keys).agg(F.min("_text").alias("_text"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Network | None, float]:
    """(network, class prior). ``learn``: a condition on id_col of the rows whose labels may be learned from."""
    bounded_batches(docs.sparkSession)
    good = labels.where(F.col(id_col).isNotNull() & (F.col(label_col) == 1)).where(learn).select(F.col(id_col).alias("_id")).distinct()
    good = sampled(good, good.count(), POSITIVES, "_id")
    d = docs.where(F.col(id_col).isNotNull()).where(learn).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    web = sampled(d, docs.count(), UNLABELLED, "_id").withColumn("_p", F.lit(False))
    both = one_text(d.join(F.broadcast(good), "_id", "left_semi").withColumn("_p", F.lit(True)).unionByName(web), "_id", "_p").select("_p", "_text")

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["p", "x"])

    got = both.mapInArrow(run, "p boolean, x binary").toArrow()
    flag = got.column("p").to_numpy()
    x = np.array([np.frombuffer(r, np.float32) for r in got.column("x").to_pylist()]).reshape(-1, FEATURES)
    order = fit_order(x, flag)
    flag, x = flag[order], x[order]
    if not flag.any() or flag.all():
        return None, 0.5
    prior = estimated_prior(x[flag], x[~flag])
    return fit(x[flag], x[~flag], prior), prior


def fit_order(x: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Order by all statistics, then by flag, so that a fit does not depend on the order in which rows came."""
    return np.lexsort((flag, *x.T[::-1]))


def with_scores(docs: DataFrame, text_col: str, score_col: str, scores) -> DataFrame:
    """``docs`` with score_col, in place of a column of that name. ``scores(bytes, offsets)``: of the texts of a slice."""
    rows = docs.select(F.col(f"`{text_col}`").alias("_text_"), *[F.col(f"`{c}`") for c in docs.columns if c != score_col])
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[1:]), f"`{score_col}` double"])

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in slices(batch.column(0)):
                out[lo:hi] = scores(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], names=[*batch.schema.names[1:], score_col])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: tuple[Network | None, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row."""
    network, prior = model
    if network is None:
        return docs.withColumn(score_col, F.lit(float(prior)))
    bounded_batches(docs.sparkSession)
    return with_scores(docs, text_col, score_col, lambda data, offsets: network.scores(features(data, offsets)))
