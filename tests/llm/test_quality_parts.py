"""Parts of the quality classifier: statistics against plain loops, the risk's gradient against differences, row order."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rolloutframe.llm import pu_quality
from rolloutframe.llm._text import slices

GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "'\"-", "#$%&*+/=?@\\^_`~", "|()<>[]{}", "!"]


def kind(byte):
    if byte > 127:
        return 10
    return next((i for i, g in enumerate(GROUPS) if chr(byte) in g), 11)


def plain(text):
    data = (text or "").encode()
    pairs = Counter((kind(a), kind(b)) for a, b in zip(data, data[1:], strict=False))
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data))
    many, n = Counter(words), max(len(words), 1)
    out = [np.sqrt(pairs[a, b] / max(len(data) - 1, 1)) for a in range(12) for b in range(12)]
    out += [np.log1p(len(words)), np.log1p(len(data)), sum(map(len, words)) / n / 10, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
    return out + [len(many) / n, max(many.values(), default=0) / n, sum(v > 1 for v in many.values()) / n]


def of(texts):
    return np.concatenate([pu_quality.features(data, offsets) for _, _, data, offsets in slices(pa.array(texts, pa.string()))])


def test_statistics_against_loops():
    texts = ["AB cd", "ab CD", "", None, "a", "a a  A\tb\n\nb! (x) caf\u00e9 \x01", "one two two two one" * 40, "x" * 5000, " \n ", "\u4f60\u597d 12,5% 'q'"]
    assert of(texts) == pytest.approx(np.array([plain(t) for t in texts]), abs=1e-5)


def risk(w, p, u, prior, unbiased):
    score = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
    plus, minus = (lambda g: np.log(1 + np.exp(-g)).mean()), (lambda g: np.log(1 + np.exp(g)).mean())
    penalty = 1e-4 / 2 * ((w[0] ** 2).sum() + (w[2] ** 2).sum())
    if not unbiased:
        return (plus(score(p)) + minus(score(u))) / 2 + penalty
    rest = minus(score(u)) - prior * minus(score(p))
    return (prior * plus(score(p)) + rest if rest >= 0 else -rest) + penalty


@pytest.mark.parametrize(("shift", "unbiased"), [(0.0, True), (-3.0, True), (0.0, False)], ids=["risk", "against the step", "two samples"])
def test_gradient_against_differences(shift, unbiased):
    r = np.random.default_rng(5)
    p, u = r.standard_normal((9, 6)) - shift, r.standard_normal((14, 6)) + shift
    w = [r.standard_normal((6, 4)), r.standard_normal(4), r.standard_normal(4), np.array(0.3)]
    if shift:  # positives score high, unlabelled low: their part of the risk is below zero
        w[0], w[2] = np.abs(w[0]), np.abs(w[2])
        score = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
        assert np.logaddexp(0, score(u)).mean() < 0.8 * np.logaddexp(0, score(p)).mean()
    for i, g in enumerate(pu_quality.gradient(w, p, u, 0.8, unbiased)):
        for at in np.ndindex(w[i].shape):
            up, down = ([x.copy() for x in w] for _ in range(2))
            up[i][at] += 1e-5
            down[i][at] -= 1e-5
            assert np.asarray(g)[at] == pytest.approx((risk(up, p, u, 0.8, unbiased) - risk(down, p, u, 0.8, unbiased)) / 2e-5, abs=1e-6)


def test_fit_order_is_one_whatever_the_rows_order():
    x = of(["AB cd", "ab CD", "AB cd", "ef GH", "EF gh", "ab CD"])
    flag = np.array([True, False, False, True, False, True])
    assert (x[0, -7:] == x[1, -7:]).all() and (x[0] != x[1]).any()
    first = pu_quality.fit_order(x, flag)
    for seed in range(20):
        other = np.random.default_rng(seed).permutation(len(x))
        again = pu_quality.fit_order(x[other], flag[other])
        assert (x[first] == x[other][again]).all() and (flag[first] == flag[other][again]).all()
