"""Approximate nearest neighbours by adaptive dimension scan.

Index: centroids come from k-means on a bounded sample (SAMPLE rows, the smallest hashes of the id), as many as the
square root of the rows, from 64 to MOST_LISTS; every row is indexed, in the list of its nearest centroid, list by list
inside each shard. Inner product search becomes distance search by one more dimension that gives all vectors one length.
A random rotation spreads a vector's length evenly over its dimensions, and rotated vectors are held in column blocks.
How many lists a query probes is measured on the sample: the fewest, at most all, that hold RECALL of the true nearest
of up to 256 sampled queries. Vectors with structure need few, directions drawn at random need most.

Search: queries probe the lists of their nearest centroids in three steps, nearest first. In each list the squared
distances of all queries that probe it grow block by block. After d of D dimensions a candidate is given up when its
partial distance, scaled by D / d, is above (1 + EPSILON / sqrt(d))**2 times the distance of the k-th best of the steps
before: the hypothesis that its whole distance is smaller is then rejected at a level that EPSILON sets. Survivors are
scored on the original vectors in double precision, component by component in order, so equal vectors have equal scores.

Recall against brute force is measured by the tests and stated in the README. Edge cases: vectors that are null, zero
or hold null or non-finite components, or have another length than most, take no part, nor do rows with a null id;
repeated rows of an id are vectors of their own, of which a query's own id is never a result, and as a query an id has
the least of its vectors; fewer candidates than k are all that are found; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._vectors import best, clean, matrix, searched, shards

SAMPLE = 20_000
MOST_LISTS = 1024
RECALL = 0.97
COLUMNS = 16
EPSILON = 2.1
CHUNK = 1024  # queries that advance together


def fit(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means centroids; empty lists keep their centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centroids)
        for c in range(len(centroids)):
            own = sample[near == c]
            if len(own):
                centroids[c] = own.mean(axis=0)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * x @ centroids.T, axis=1)


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float = RECALL, asked: int = 256) -> int:
    """The fewest lists to probe that hold ``recall`` of the k nearest of sampled queries; last columns are the lengths' rest."""
    q = np.column_stack([sample[:asked, :-1], np.zeros(min(asked, len(sample)))])
    far = (sample**2).sum(axis=1) - 2 * q @ sample.T
    far[np.arange(len(q)), np.arange(len(q))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    true = np.argpartition(far, k - 1, axis=1)[:, :k]
    order = np.argsort((centroids**2).sum(axis=1) - 2 * q @ centroids.T, axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centroids))[None], axis=1)
    own = np.take_along_axis(rank, nearest(sample, centroids)[true], axis=1)
    return int(np.quantile(own, recall, method="higher")) + 1


class Index:
    """The lists of one shard."""

    def __init__(self, ids, x, longest, rotation, centroids, probes, k):
        extra = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
        y = np.column_stack([x, extra])
        near = nearest(y, centroids)
        order = np.lexsort((ids, near))
        self.k, self.probes, self.rotation, self.centroids = k, probes, rotation, centroids
        self.ids, self.x = ids[order], x[order]
        y = (y[order] @ rotation).astype(np.float32)
        self.dims = y.shape[1]
        self.blocks = [np.ascontiguousarray(y[:, d : d + COLUMNS]) for d in range(0, self.dims, COLUMNS)]
        self.norms = [(b**2).sum(axis=1) for b in self.blocks]
        self.start = np.searchsorted(near[order], np.arange(len(centroids) + 1))

    def scan(self, c: int, turned: np.ndarray, limit: np.ndarray):
        """(query numbers, rows, squared distances) of the candidates of list c that no test gives up."""
        lo, hi = self.start[c], self.start[c + 1]
        whole, d, pairs = np.zeros((len(turned), hi - lo), np.float32), 0, None
        for block, norm in zip(self.blocks, self.norms, strict=True):
            w = turned[:, d : d + block.shape[1]]
            d += block.shape[1]
            level = limit * ((1 + EPSILON / np.sqrt(d)) ** 2 * d / self.dims if d < self.dims else 1.0001) + 1e-4
            if pairs is None:  # most candidates are alive: whole products
                whole += norm[lo:hi] + (w**2).sum(axis=1)[:, None] - 2 * (w @ block[lo:hi].T)
                live = whole <= level[:, None]
                if d == self.dims or np.count_nonzero(live) < live.size // 8:
                    q, row = np.nonzero(live)
                    pairs, partial = (q, row + lo), whole[q, row]
            else:
                q, row = pairs
                partial = partial + norm[row] + (w**2).sum(axis=1)[q] - 2 * np.einsum("ij,ij->i", block[row], w[q])
                live = partial <= level[q]
                pairs, partial = (q[live], row[live]), partial[live]
        return *pairs, partial

    def chunk(self, ids: np.ndarray, q: np.ndarray):
        padded = np.column_stack([q, np.zeros(len(q))])
        turned = (padded @ self.rotation).astype(np.float32)
        order = np.argsort((self.centroids**2).sum(axis=1) - 2 * padded @ self.centroids.T, axis=1)[:, : self.probes]
        limit = np.full(len(q), np.inf, np.float32)
        who, row, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        cuts = sorted({0, *(min(x, self.probes) for x in (4, 16, self.probes))})
        for lo, hi in zip(cuts, cuts[1:]):
            found = [(who, row, far)]
            probed = order[:, lo:hi]
            by = np.argsort(probed.ravel(), kind="stable")
            queries, at = by // probed.shape[1], np.searchsorted(probed.ravel()[by], np.arange(len(self.centroids) + 1))
            for c in np.flatnonzero((np.diff(at) > 0) & (np.diff(self.start) > 0)).tolist():
                some = queries[at[c] : at[c + 1]]
                n, r, f = self.scan(c, turned[some], limit[some])
                n = some[n]
                away = self.ids[r] != ids[n]
                found.append((n[away], r[away], f[away]))
            who, row, far = (np.concatenate(x) for x in zip(*found, strict=True))
            rank = np.lexsort((far, who))
            who, row, far = who[rank], row[rank], far[rank]
            first = np.searchsorted(who, np.arange(len(q) + 1))
            full = np.flatnonzero(np.diff(first) >= self.k)
            limit[full] = far[first[full] + self.k - 1]
            keep = far <= limit[who] * 1.0001 + 1e-4  # ties of the last place, and what float32 can't tell apart
            who, row, far = who[keep], row[keep], far[keep]
        score = np.zeros(len(who))
        for d in range(q.shape[1]):
            score += self.x[row, d] * q[who, d]
        rank = np.lexsort((self.ids[row], -score, who))
        who, row, score = who[rank], row[rank], score[rank]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        return who[keep], self.ids[row[keep]], score[keep]

    def search(self, ids: np.ndarray, q: np.ndarray):
        found = [(lo, *self.chunk(ids[lo : lo + CHUNK], q[lo : lo + CHUNK])) for lo in range(0, len(ids), CHUNK)]
        return np.concatenate([lo + w for lo, w, _, _ in found]), np.concatenate([i for _, _, i, _ in found]), np.concatenate([s for _, _, _, s in found])


def adaptive_search(vectors: DataFrame, queries: Column, k: int = 20, lists: int | None = None, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query of the stated set."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = clean(vectors, id_col, vector_col, zero=False)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    count, longest = rows.agg(F.count("*"), F.max(length)).first()
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    if not count:
        return empty
    sample = matrix(rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").toArrow().column("v"))
    sample = np.column_stack([sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(axis=1), 0))])
    centroids = fit(sample, lists or min(max(64, int(count**0.5)), MOST_LISTS), seed=seed)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((sample.shape[1],) * 2))[0]
    asked = rows.withColumn(id_col, F.col("id")).where(queries).groupBy("id").agg(F.min("v").alias("v"))
    sent = spark.sparkContext.broadcast((longest, rotation, centroids, probes or probes_for(sample, centroids, k)))
    found = searched(shards(rows, count), asked, lambda ids, x: Index(ids, x, *sent.value, k), "double")
    return empty if found is None else best(found, k, id_col, F.desc("score"))
