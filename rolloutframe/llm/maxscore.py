"""Exact top-k search by MaxScore over integer vectors.

A term is a dimension with a sign. A shard stores its posting list, the vectors whose component has that sign, so with
a query's weights every posting adds a positive amount; components of the other sign only lower a score. A term's bound
is the query's weight times the shard's largest component of that sign. Each list also keeps its CHAMPIONS, the vectors
of the largest components.

For each query terms are sorted by bound. With a threshold (the k-th best score so far, first of the champions of the
strongest terms), the terms of the smallest bounds that cannot reach the threshold together are non-essential: a vector
on none of the other, essential lists cannot compete. The essential lists are traversed, and the vectors on them get
their whole scores of the essential terms; then the other terms are probed one block after another, largest bound first,
for the vectors whose score so far plus the bounds that remain still reaches the threshold. Vectors that reach it at the
end compete. All sums are integers below 2**53 held exactly; a threshold is a score that k vectors of the shard other
than the query's own have, so nothing is lost, and ties stay in. The shards' winners merge by score, ties to the smaller
id.

Edge cases: vectors that are null, or hold null or non-finite components, or have another length than most, take no
part; nor do rows with a null id; repeated rows of an id are vectors of their own, of which a query's own id is never a
result, and as a query an id has the least of its vectors; fewer candidates than k are all returned; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._vectors import best, clean, searched, shards

BLOCK = 8  # non-essential terms that are probed at a time
CHAMPIONS = 32


class Shard:
    """Posting lists of both signs of every dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.k, self.ids = k, ids[order]
        self.lists = np.ascontiguousarray(x[order].T)  # by dimension
        self.high, self.low = np.maximum(self.lists.max(axis=1), 0), np.minimum(self.lists.min(axis=1), 0)
        top = min(max(CHAMPIONS, 4 * k), len(ids))
        self.postings, self.champions = {}, {}
        for d, values in enumerate(self.lists):
            for sign in (-1, 1):
                at = np.flatnonzero(values * sign > 0).astype(np.int32)
                self.postings[d, sign] = at
                self.champions[d, sign] = at[np.argpartition(-sign * values[at], top - 1)[:top]] if len(at) > top else at

    def on(self, terms: list) -> np.ndarray:
        """The vectors on any of the lists."""
        mark, left = np.zeros(len(self.ids), bool), len(self.ids)
        for i, t in enumerate(terms):
            mark[self.postings[t]] = True
            if i % 8 == 7 and mark.all():
                return np.arange(left)
        return np.flatnonzero(mark)

    def one(self, own: int, q: np.ndarray):
        """(places, scores) of the k best rows but ``own``, ties to the smaller id."""
        k, n = self.k, len(self.ids)
        lo, hi = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")  # the query's own rows
        bound = np.where(q > 0, q * self.high, q * self.low)
        order = np.argsort(-bound, kind="stable")
        order = order[q[order] != 0]
        terms = [(d, 1 if q[d] > 0 else -1) for d in order.tolist()]
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])  # bounds of the terms from here on
        seeds = np.unique(np.concatenate([self.champions[t] for t in terms[:4]] or [np.zeros(0, np.int32)]))
        seeds = seeds[(seeds < lo) | (seeds >= hi)]
        threshold = -np.inf
        if len(seeds) >= k:
            scores = q @ self.lists[:, seeds]
            threshold = np.partition(scores, len(scores) - k)[len(scores) - k]
        essential = int(np.searchsorted(-rest[:-1], -threshold, "right"))  # from there on bounds are below the threshold
        first = order[:essential]
        # where all terms are essential, a vector on no list scores at most 0, which may be enough
        at = self.on(terms[:essential]) if essential < len(order) else np.arange(n)
        score = q[first] @ (self.lists[first] if len(at) == n else self.lists[first[:, None], at])
        away = (at < lo) | (at >= hi)
        at, score = at[away], score[away]
        t = essential
        while True:
            live = score + rest[t] >= threshold
            if not live.all():
                at, score = at[live], score[live]
            if t == len(order):
                break
            some = order[t : t + BLOCK]
            score = score + q[some] @ self.lists[some[:, None], at]
            t += len(some)
            if len(score) > 8 * k:  # a score so far and the worst that remains is a score that this vector reaches
                left = order[t:]
                worst = np.where(q[left] > 0, q[left] * self.low[left], q[left] * self.high[left]).sum()
                threshold = max(threshold, np.partition(score, len(score) - k)[len(score) - k] + worst)
        top = np.lexsort((self.ids[at], -score))[:k]
        return at[top], score[top]

    def search(self, ids: np.ndarray, q: np.ndarray):
        found = [self.one(i, w) for i, w in zip(ids.tolist(), q, strict=True)]
        at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.repeat(np.arange(len(ids)), [len(a) for a, _ in found]), self.ids[at], score.astype(np.int64)


def maxscore(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): the k largest integer inner products of floor(scale * component) vectors.

    ``queries``: a condition on id_col that states the query set.
    """
    bounded_batches(vectors.sparkSession)
    rows = clean(vectors, id_col, vector_col, zero=True)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    asked = rows.withColumn(id_col, F.col("id")).where(queries).groupBy("id").agg(F.min("v").alias("v"))
    found = searched(shards(rows, rows.count()), asked, lambda ids, x: Shard(ids, x, k), "long")
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    return best(found, k, id_col, F.desc("score"))
