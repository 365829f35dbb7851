"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Inputs of a word: a learned vector of the word, and of its characters: learned vectors of the byte 4-grams and 5-grams
that it holds (a blank marks its front), pooled by mean and by maximum; case, length, signs. Words and grams with a
vector are those whose documents in the fitting sample are toxic clearly more or less often than others', at most
MOST_ENTRIES of each kind, the clearest; any other has a vector of zeros. A vector starts as the log odds of toxic
documents and a zero, and is learned with the network, through the pooling.

Gated recurrent layers run over the text from both sides, attention weighs their states, and one output scores the pool
of a window of WINDOW words. A window begins at every word, so all overlapping windows are scored: the pool's weighted
mean is linear in the output, so prefix sums give every window's score in constant time. The layers run over stretches
of STRETCH words that advance together, each from CONTEXT words further out. The text's score is a logistic function of
its highest window and the number of windows.

Everything is trained here in numpy, by Adam through time, on a bounded sample (SAMPLE labelled documents of at most
LONGEST bytes): vectors and network on three quarters, the logistic function on the rest, which neither has seen. From a
toxic document the window with the most evidence is taken for toxic; from the others the windows with the most evidence
and others at random are clean. Scoring is one pass without a shuffle over whole texts.

Edge cases: null and empty texts are one empty window; without both labels to learn from, every score is the share of
toxic labels; several labels of one id count once each; of repeated rows of an id the least text is learned from; rows
with a null id are scored and never learned from; repeated rows score alike, up to the last
digits (matrix products round by their shape, so by what stands beside a text); other columns stay, but one named like the
score is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._text import LOWER, U64, mix64, range_hashes, slices, spans
from .pu_quality import one_text, sampled, with_scores

SAMPLE, LONGEST, FIT_SLICE = 4_000, 60_000, 1 << 19
WINDOW, CONTEXT, STRETCH = 32, 16, 64
HIDDEN, EPOCHS, BATCH, RATE = 8, 8, 128, 5e-3
GRAMS = (4, 5)
D = 2  # of a learned vector
LEARNED, SHAPE = D * (1 + 2 * len(GRAMS)), 5
INPUTS = LEARNED + SHAPE
MOST_ENTRIES = 20_000  # of each table of vectors
SPARE = 4  # of as many texts of a label one is left for the logistic function
LANES = 2048  # stretches that advance together

NOT_WORD = np.ones(256, bool)  # words are letters, digits and everything beyond ASCII
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    NOT_WORD[list(_r)] = False


class Table:
    """Rows of 64-bit keys; keys that aren't in it have the last row + 1."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.keys, self.shift = keys, U64(64 - bits)  # sorted
        self.bucket = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=U64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.keys), np.int32)
        at = (h >> self.shift).astype(np.int64)
        row, end = self.bucket[at], self.bucket[at + 1]
        live = np.flatnonzero(row < end)
        row, end = row[live], end[live]
        while len(live):
            good = self.keys[row] == h[live]
            out[live[good]] = row[good]
            on = ~good & (row + 1 < end)
            live, row, end = live[on], row[on] + 1, end[on]
        return out


class Words:
    """The words of a slice; their distinct lower-cased forms with the hashes of their 4-grams and 5-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.starts, self.ends, self.doc = spans(data, offsets, NOT_WORD)
        low = LOWER[data]
        self.hash, pick, self.which = np.unique(range_hashes(low, self.starts, self.ends), return_index=True, return_inverse=True)
        self.data = data
        # a word's grams begin at its blank in front and run inside the word; a word too short for one has none
        start, size = self.starts[pick], (self.ends - self.starts)[pick]
        wide = np.concatenate([np.full(1, 32, np.uint8), low, np.full(5, 32, np.uint8)]).astype(U64)
        self.grams = []
        for k in GRAMS:
            many = np.maximum(size + 2 - k, 0)
            word = np.repeat(np.arange(len(size)), many)
            inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            at = start[word] + inside  # in wide, where everything stands one later, this is one before
            packed = np.full(len(at), k, U64)
            for j in range(k):
                byte = wide[at + j]
                if j == 0:
                    byte = np.where(inside == 0, U64(32), byte)
                packed = packed << U64(8) | byte
            self.grams.append((mix64(packed), word, many))

    def shape(self) -> np.ndarray:
        out = np.zeros((len(self.starts), SHAPE), np.float32)
        if len(out):
            first = self.data[self.starts]
            after = self.data[np.minimum(self.ends, len(self.data) - 1)]
            out[:, 0] = (first < 91) & (first > 64)
            out[:, 1] = np.minimum(self.ends - self.starts, 20) / 10
            out[:, 2] = (after < 48) & (after > 32)
            out[:, 3] = first > 127
            out[:, 4] = 1
        return out


class Known:
    """Distinct words as rows of the tables: the word's, and the known grams of each kind (rows, words, all its grams)."""

    def __init__(self, words: Words, tables: list[Table]):
        self.n = len(words.hash)
        self.word = tables[0](words.hash)
        self.grams = []
        for (h, word, many), table in zip(words.grams, tables[1:], strict=True):
            row = table(h)
            there = row < len(table.keys)
            self.grams.append((row[there], word[there], np.maximum(many, 1).astype(np.float32)))


def pooled(known: Known, vectors: list[np.ndarray]) -> np.ndarray:
    """The learned inputs of distinct words; a table's last vector stands for all without one and is zero."""
    out = np.zeros((known.n, LEARNED), np.float32)
    out[:, :D] = vectors[0][known.word]
    for i, ((row, word, many), v) in enumerate(zip(known.grams, vectors[1:], strict=True)):
        c = D * (1 + 2 * i)
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            own = v[row]
            out[word[first], c : c + D] = np.add.reduceat(own, first) / many[word[first], None]
            out[word[first], c + D : c + 2 * D] = np.maximum(np.maximum.reduceat(own, first), 0)
    return out


def pooled_gradients(known: Known, vectors: list[np.ndarray], x: np.ndarray, dx: np.ndarray) -> list[np.ndarray]:
    out = [np.zeros_like(v) for v in vectors]
    np.add.at(out[0], known.word, dx[:, :D])
    for i, ((row, word, many), v) in enumerate(zip(known.grams, vectors[1:], strict=True)):
        c = D * (1 + 2 * i)
        top = x[word, c + D : c + 2 * D]
        np.add.at(out[1 + i], row, dx[word, c : c + D] / many[word, None] + np.where((v[row] == top) & (top > 0), dx[word, c + D : c + 2 * D], 0))
    for g in out:
        g[-1] = 0
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters: for each direction wx, wh, b of the gates (update, reset, candidate); attention wa, ba, va; output wo, bo."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"wx{d}": r(INPUTS, 3 * HIDDEN), f"wh{d}": r(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"wa": r(2 * HIDDEN, HIDDEN), "ba": np.zeros(HIDDEN, np.float32), "va": r(HIDDEN), "wo": r(2 * HIDDEN), "bo": np.zeros((), np.float32)}
        self.vectors: list[np.ndarray] = []
        self.a, self.b, self.c = 1.0, 0.0, 0.0  # the text's score: a * highest window + b * log windows + c

    def direction(self, d: str, g: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, lanes, HIDDEN) of a layer over gate inputs in the order in which it reads them."""
        k, wh = HIDDEN, self.p[f"wh{d}"]
        out = np.zeros((*mask.shape, k), np.float32)
        h = np.zeros((mask.shape[1], k), np.float32)
        for t in range(len(mask)):
            u = h @ wh
            zr = _sigmoid(g[t][:, : 2 * k] + u[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(g[t][:, 2 * k :] + r * u[:, 2 * k :])
            new = h + mask[t][:, None] * z * (c - h)
            if keep is not None:
                keep.append((t, h, u, z, r, c))
            out[t] = h = new
        return out

    def gates(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.p[f"wx{d}"] + self.p[f"b{d}"]

    def attend(self, s: np.ndarray):
        a = np.tanh(s @ self.p["wa"] + self.p["ba"])
        return a, a @ self.p["va"]

    def forward(self, x: np.ndarray, mask: np.ndarray, core: np.ndarray, kept: dict | None = None):
        """(states, attention layer, weights, pool, logits) of windows in their context; time first. core: places to pool."""
        keep = {d: [] if kept is not None else None for d in "fb"}
        s = np.concatenate([self.direction("f", self.gates(x, "f"), mask, keep["f"]), self.direction("b", self.gates(x[::-1], "b"), mask[::-1], keep["b"])[::-1]], axis=2)
        if kept is not None:
            kept.update(keep)
        a, e = self.attend(s)
        e = e + np.where(core, 0, -1e4).astype(np.float32)
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        ctx = (w[:, :, None] * s).sum(axis=0)
        return s, a, w, ctx, ctx @ self.p["wo"] + self.p["bo"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, core: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted logistic loss, by the parameters and by x (words, windows, INPUTS)."""
        k, kept = HIDDEN, {}
        s, a, w, ctx, logit = self.forward(x, mask, core, kept)
        grad = {n: np.zeros_like(v) for n, v in self.p.items()}
        dl = (_sigmoid(logit) - y) * weight / weight.sum()
        grad["wo"], grad["bo"] = ctx.T @ dl, dl.sum()
        dctx = dl[:, None] * self.p["wo"]
        dw = (s * dctx).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        da = de[:, :, None] * self.p["va"] * (1 - a * a)
        grad["va"] = (a * de[:, :, None]).sum(axis=(0, 1))
        grad["wa"], grad["ba"] = np.tensordot(s, da, ((0, 1), (0, 1))), da.sum(axis=(0, 1))
        ds = w[:, :, None] * dctx + da @ self.p["wa"].T
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            carry = np.zeros((x.shape[1], k), np.float32)
            for t, h, u, z, r, c in reversed(kept[d]):
                at = t if d == "f" else len(x) - 1 - t
                on = mask[at][:, None]
                dh = carry + ds[at][:, k * i : k * (i + 1)]
                dz, dc = dh * on * (c - h), dh * on * z
                dcp, dzp = dc * (1 - c * c), dz * z * (1 - z)
                drp = dcp * u[:, 2 * k :] * r * (1 - r)
                dg = np.concatenate([dzp, drp, dcp], axis=1)
                du = np.concatenate([dzp, drp, dcp * r], axis=1)
                grad[f"wx{d}"] += x[at].T @ dg
                grad[f"b{d}"] += dg.sum(axis=0)
                grad[f"wh{d}"] += h.T @ du
                dx[at] += dg @ self.p[f"wx{d}"].T
                carry = dh - dh * on * z + du @ self.p[f"wh{d}"].T
        return grad, dx

    def fit(self, known: Known, word: np.ndarray, shape: np.ndarray, core: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 9):
        """Adam over windows in their context. word: number of the distinct word at each place, -1 beyond the text."""
        rng = np.random.default_rng(seed)
        m, v, t = {}, {}, 0
        for _ in range(max(EPOCHS, -(-240 * BATCH // len(y)))):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                b = order[lo : lo + BATCH]
                own = word[:, b]
                vector = pooled(known, self.vectors)
                x = np.concatenate([vector[own] * (own >= 0)[:, :, None], shape[:, b]], axis=2)
                grad, dx = self.gradients(x, own >= 0, core[:, b], y[b], weight[b])
                dv = np.zeros_like(vector)
                np.add.at(dv, own[own >= 0], dx[:, :, :LEARNED][own >= 0])
                params = {**self.p, **{f"v{i}": e for i, e in enumerate(self.vectors)}}
                grad |= {f"v{i}": g for i, g in enumerate(pooled_gradients(known, self.vectors, vector, dv))}
                t += 1
                for n, g in grad.items():
                    m[n] = 0.9 * m.get(n, 0) + 0.1 * g
                    v[n] = 0.999 * v.get(n, 0) + 0.001 * g * g
                    rate = RATE if n in self.p else RATE / 4
                    params[n] = (params[n] - rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
                self.p = {n: params[n] for n in self.p}
                self.vectors = [params[f"v{i}"] for i in range(len(self.vectors))]

    def strengths(self, words: Words, tables: list[Table]) -> tuple[np.ndarray, np.ndarray]:
        """(attention before the softmax, output) of every word, from states over stretches."""
        n = len(words.starts)
        vector, shape = pooled(Known(words, tables), self.vectors), words.shape()
        count = np.bincount(words.doc, minlength=words.n)
        many = -(-count // STRETCH)
        doc = np.repeat(np.arange(words.n), many)
        first = (np.cumsum(count) - count)[doc]
        begin = first + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
        last = first + count[doc]
        states = np.zeros((n, 2 * HIDDEN), np.float32)
        for i, d in enumerate("fb"):
            wx = self.p[f"wx{d}"]
            by_word = vector @ wx[:LEARNED] + self.p[f"b{d}"]
            for lo in range(0, len(doc), LANES):
                b, f, e = begin[lo : lo + LANES], first[lo : lo + LANES], last[lo : lo + LANES]
                steps = np.arange(STRETCH + CONTEXT)[:, None]
                place = b - CONTEXT + steps if d == "f" else b + STRETCH + CONTEXT - 1 - steps
                mask = (place >= f) & (place < e)
                at = np.where(mask, place, 0)
                s = self.direction(d, by_word[words.which[at]] + shape[at] @ wx[LEARNED:], mask)
                own = mask & (steps >= CONTEXT)
                states[place[own], HIDDEN * i : HIDDEN * (i + 1)] = s[own]
        return self.attend(states)[1], states @ self.p["wo"]

    def highest(self, words: Words, tables: list[Table]) -> tuple[np.ndarray, np.ndarray]:
        """(score of the highest window, number of windows) of each text."""
        count = np.bincount(words.doc, minlength=words.n)
        many = np.maximum(count - WINDOW + 1, 1)
        out = np.full(words.n, float(self.p["bo"]))
        if len(words.starts):
            e, o = self.strengths(words, tables)
            e = np.exp(e.astype(np.float64))
            sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (e, e * o)]
            full = np.flatnonzero(count)
            doc = np.repeat(full, many[full])
            at = np.cumsum(many[full]) - many[full]
            begin = (np.cumsum(count) - count)[doc] + np.arange(len(doc)) - np.repeat(at, many[full])
            end = begin + np.minimum(WINDOW, count[doc])
            score = (sums[1][end] - sums[1][begin]) / (sums[0][end] - sums[0][begin])
            out[full] += np.maximum.reduceat(score, at)
        return out, many

    def scores(self, data: np.ndarray, offsets: np.ndarray, tables: list[Table]) -> np.ndarray:
        top, many = self.highest(Words(data, offsets), tables)
        return 1 / (1 + np.exp(-np.clip(self.a * top + self.b * np.log(many) + self.c, -40, 40)))


class Evidence:
    """Documents and toxic documents of each key; grown slice by slice."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, U64), np.zeros((0, 2), np.int64)

    def add(self, keys: np.ndarray, owner: np.ndarray, y: np.ndarray):
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[new], owner[new]
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.zeros((len(both), 2), np.int64)
        counts[at[: len(self.keys)]] = self.counts
        counts += np.column_stack([np.bincount(at[len(self.keys) :], f, len(both)) for f in (None, y[owner])]).astype(np.int64)
        self.keys, self.counts = both, counts

    def table(self, share: float, least: int) -> tuple[Table, np.ndarray]:
        """The clearest keys in at least ``least`` documents, and their first vectors."""
        count, toxic = self.counts.T.astype(np.float64)
        # pseudo-documents at the base rate, so a key seen once or twice says little
        odds = np.log((toxic + 2 * share) / (count - toxic + 2 * (1 - share))) - np.log(share / (1 - share))
        z = np.abs(toxic - count * share) / np.sqrt(np.maximum(count, 1) * share * (1 - share))
        pick = np.flatnonzero((count >= least) & (z > 3))
        pick = np.sort(pick[np.argsort(-z[pick], kind="stable")[:MOST_ENTRIES]])
        vectors = np.zeros((len(pick) + 1, D), np.float32)
        vectors[:-1, 0] = odds[pick]
        return Table(self.keys[pick]), vectors


def hottest(words: Words, heat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, heat) of the window with the most evidence among those that begin in the same WINDOW words."""
    count = np.bincount(words.doc, minlength=words.n)
    first = np.cumsum(count) - count
    many = np.maximum(count - WINDOW + 1, 0) + ((count > 0) & (count < WINDOW))
    doc = np.repeat(np.arange(words.n), many)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = first[doc] + place
    run = np.concatenate([[0.0], np.cumsum(heat)])
    own = run[begin + np.minimum(WINDOW, count[doc])] - run[begin]
    order = np.lexsort((place, -own, place // WINDOW, doc))
    cell = np.stack([doc[order], place[order] // WINDOW])
    top = order[np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)])] if len(order) else order
    return doc[top], begin[top], own[top]


def fit(texts: list[str], y: np.ndarray, seed: int = 13) -> tuple[Network, list[Table]]:
    """A network with its vectors from labelled texts, in passes over slices of the texts."""
    y = y.astype(np.float64)
    rng = np.random.default_rng(seed)
    # some texts of each label are left for the logistic function, where there are enough
    spare = np.zeros(len(y), bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        spare[own[: len(own) // SPARE]] = True
    learn, share = np.flatnonzero(~spare), float(y[~spare].mean())
    array = pa.array([texts[i] for i in learn], pa.large_string())
    counts = [Evidence() for _ in range(1 + len(GRAMS))]
    for lo, hi, data, offsets in slices(array, FIT_SLICE):
        words = Words(data, offsets)
        pair = np.unique(words.which * words.n + words.doc)
        u, doc, own = pair // words.n, pair % words.n, y[learn[lo:hi]]
        counts[0].add(words.hash[u], doc, own)
        for c, (h, _, many) in zip(counts[1:], words.grams, strict=True):
            first = np.cumsum(many) - many
            at = np.repeat(first[u], many[u]) + np.arange(int(many[u].sum())) - np.repeat(np.cumsum(many[u]) - many[u], many[u])
            c.add(h[at], np.repeat(doc, many[u]), own)
    made = [c.table(share, n) for c, n in zip(counts, (2, 4, 4), strict=True)]
    del counts
    tables = [t for t, _ in made]
    network = Network()
    network.vectors = [v for _, v in made]
    # windows to learn from, with their context
    parts, base = [], 0
    around = np.arange(-CONTEXT, WINDOW + CONTEXT)[:, None]
    for lo, _, data, offsets in slices(array, FIT_SLICE):
        words = Words(data, offsets)
        if not len(words.starts):
            continue
        known = Known(words, tables)
        x = pooled(known, network.vectors)
        heat = np.maximum(x[:, [0, *(D * (2 + 2 * i) for i in range(len(GRAMS)))]], 0).sum(axis=1)
        doc, begin, own = hottest(words, heat[words.which])
        rank = np.lexsort((rng.random(len(doc)), -own, doc))
        number = np.empty(len(doc), np.int64)
        number[rank] = np.arange(len(doc)) - np.searchsorted(doc, doc)
        target = y[learn[lo + doc]]
        use = np.flatnonzero((number == 0) | ((target == 0) & ((number <= 2) | (rng.random(len(doc)) < 0.05))))
        count = np.bincount(words.doc, minlength=words.n)
        first = (np.cumsum(count) - count)[doc[use]]
        last = first + count[doc[use]]
        place = begin[use] + around
        there = (place >= first) & (place < last)
        at = np.where(there, place, 0)
        parts.append((np.where(there, words.which[at] + base, -1).astype(np.int32), words.shape()[at] * there[:, :, None], there & (around >= 0) & (around < WINDOW), target[use].astype(np.float32), known))
        base += known.n
    every = Known.__new__(Known)
    every.n, every.word, every.grams = base, np.concatenate([p[4].word for p in parts]), []
    before = np.cumsum([0] + [p[4].n for p in parts])
    for i in range(len(GRAMS)):
        every.grams.append((np.concatenate([p[4].grams[i][0] for p in parts]), np.concatenate([p[4].grams[i][1] + b for p, b in zip(parts, before)]), np.concatenate([p[4].grams[i][2] for p in parts])))
    word, shape, core = (np.concatenate([p[i] for p in parts], axis=1) for i in range(3))
    target = np.concatenate([p[3] for p in parts])
    del parts
    every, word = narrowed(every, word)
    weight = np.where(target > 0, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())).astype(np.float32) * len(target)
    network.fit(every, word, shape, core, target, weight)
    rest = np.flatnonzero(spare) if spare.any() and 0 < y[spare].sum() < spare.sum() else np.arange(len(y))
    top, many = np.zeros(len(rest)), np.zeros(len(rest))
    for lo, hi, data, offsets in slices(pa.array([texts[i] for i in rest], pa.large_string()), FIT_SLICE):
        top[lo:hi], many[lo:hi] = network.highest(Words(data, offsets), tables)
    network.a, network.b, network.c = logistic(np.column_stack([top, np.log(many), np.ones(len(rest))]), y[rest])
    return network, tables


def narrowed(known: Known, word: np.ndarray) -> tuple[Known, np.ndarray]:
    """Only the distinct words that ``word`` names."""
    used, back = np.unique(word, return_inverse=True)
    back, used = back.reshape(word.shape), used
    if used[0] < 0:
        used, back = used[1:], back - 1
    to = np.full(known.n, -1)
    to[used] = np.arange(len(used))
    out = Known.__new__(Known)
    out.n, out.word, out.grams = len(used), known.word[used], []
    for row, owner, many in known.grams:
        keep = to[owner] >= 0
        out.grams.append((row[keep], to[owner[keep]], many[used]))
    return out, back


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, g)
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(network, tables), or the share of toxic labels. ``learn``: a condition on id_col of rows to learn labels from."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    own = sampled(own, own.count(), SAMPLE, "_id")
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.octet_length("_text") <= LONGEST)
    got = one_text(d.join(F.broadcast(own), "_id"), "_id", "_y").toArrow().sort_by([("_id", "ascending"), ("_y", "ascending")])
    y = got.column("_y").to_numpy()
    if not 0 < y.sum() < len(y):
        return (float(y.sum()) + 0.5) / (len(y) + 1)
    return fit(got.column("_text").to_pylist(), y)


def score(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row."""
    if isinstance(model, float):
        return docs.withColumn(score_col, F.lit(model))
    bounded_batches(docs.sparkSession)
    network, tables = model
    return with_scores(docs, text_col, score_col, lambda data, offsets: network.scores(data, offsets, tables))
