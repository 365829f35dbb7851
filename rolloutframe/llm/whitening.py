"""Embedding whitening by TSQR and one-sided Jacobi rotations.

Entries become whole numbers, so the sums of every dimension are exact and rows are centred as (n * x - S) / n, with the
numerator exact. Tasks compress their centred rows block by block to an upper triangle R (QR of the triangle so far on
top of the next block); triangles of many tasks are stacked and compressed again, FAN at a time, until one is left.
R' * R is n times the covariance. Plane rotations make the columns of R orthogonal (one-sided Jacobi, disjoint planes
at a time): the product of the rotations holds the components, and the columns' lengths over the root of n are the
standard deviations, without squaring anything.

The covariance of the whitened rows is measured on all of them before they are returned.

Scale: passes without a shuffle but for the triangles and sums of tasks, d x d numbers each; the last FAN triangles,
d x d sums and the rotations are the driver's, bounded by the dimension.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are vectors of
another length than most have (of equally many, the longest); a null id stays; repeated rows count once each; an entry
whose 64-fold is beyond 2**62 counts as 2**62; a deviation beyond a long is null; components without spread (a standard
deviation that is zero next to the first one's, up to rounding) have no rows, so equal vectors or a single one give none;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, delete, saved
from ._vectors import matrix

UNIT, SHIFT, TOP = 64.0, 1_000_000, float(1 << 62)
FAN = 32
ROWS = 2048  # of a block


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id, v (array<double>) of the rows that take part, and their dimension."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(F.coalesce(good, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d), d


def whole(v: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 of every entry, as long."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(UNIT * v), -TOP, TOP).astype(np.int64) + SHIFT


def some(batches, i: int = 0):
    """The vectors of each batch that has rows."""
    return (matrix(b.column(i)) for b in batches if b.num_rows)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, the sum of every dimension), exact."""

    def run(batches):
        n, total = 0, [0] * d
        for v in some(batches):
            x = whole(v)
            high, low = x >> 31, x & ((1 << 31) - 1)  # sums of halves stay longs
            total = [t + (int(h) << 31) + int(b) for t, h, b in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([*range(d), d]), pa.array([*total, n], pa.decimal128(38, 0))], names=["i", "s"])

    got = {r["i"]: int(r["s"]) for r in rows.select("v").mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return got.get(d, 0), [got.get(i, 0) for i in range(d)]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, exact: longs where they suffice, else Python's whole numbers."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, s), default=0)
    if most < 1 << 62:
        return x * n - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """The sum of squares of every row of centred(), None beyond a long."""
    most = float(np.abs(y).max(initial=0)) ** 2 * y.shape[1]
    got = (y * y).sum(axis=1) if most < 2.0**62 else (y.astype(object) ** 2).sum(axis=1)
    return [int(a) if a < 1 << 63 else None for a in got.tolist()]


def triangle(blocks, d: int) -> np.ndarray:
    """The R of all rows of ``blocks``, with as many rows as there were, at most d."""
    r = np.zeros((0, d))
    for b in blocks:
        for lo in range(0, len(b), ROWS):
            r = np.linalg.qr(np.concatenate([r, b[lo : lo + ROWS]]), mode="r")
    return r


def tsqr(rows: DataFrame, d: int, n: int, s: list[int]) -> np.ndarray:
    """The d x d upper triangle whose R' * R is that of all centred rows."""
    spark = rows.sparkSession

    def first(batches):
        r = triangle(((centred(whole(v), n, s) / n).astype(np.float64) for v in some(batches)), d)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def more(batches):
        r = triangle((np.frombuffer(x, np.float64).reshape(-1, d) for b in batches for x in b.column(0).to_pylist()), d)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    level = saved(rows.select("v").mapInArrow(first, "r binary").where(F.length("r") > 0))
    while (count := level.count()) > FAN:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a triangle may be of megabytes
        next_level = saved(level.repartition(-(-count // FAN)).mapInArrow(more, "r binary").where(F.length("r") > 0))
        delete(level)
        level = next_level
    r = triangle((np.frombuffer(x["r"], np.float64).reshape(-1, d) for x in level.toLocalIterator()), d)
    delete(level)
    return np.concatenate([r, np.zeros((d - len(r), d))])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(V, lengths): the columns of r @ V are orthogonal, longest first, with these lengths."""
    d = r.shape[1]
    a, v = r.astype(np.float64).T.copy(), np.eye(d)  # rows are columns of r and of V
    ring = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            p, q = np.minimum(ring[:half], ring[half:][::-1]), np.maximum(ring[:half], ring[half:][::-1])
            p, q = p[q < d], q[q < d]
            x, y = a[p], a[q]
            aa, bb, ab = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            on = np.abs(ab) > 1e-15 * np.sqrt(aa) * np.sqrt(bb)
            if on.any():
                turned = True
                p, q = p[on], q[on]
                with np.errstate(over="ignore"):  # planes that hardly turn
                    z = (bb[on] - aa[on]) / (2 * ab[on])
                    t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
                c = (1 / np.hypot(1, t))[:, None]
                sn = c * t[:, None]
                for m in (a, v):
                    m[p], m[q] = c * m[p] - sn * m[q], sn * m[p] + c * m[q]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    length = np.sqrt((a * a).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    return v[order].T, length[order]


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of every row for the first ``most`` components."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema[id_col].dataType
    rows, d = usable(vectors, id_col, vector_col)
    n, s = sums(rows, d)
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not n:
        return spark.createDataFrame([], "component int, n long, deviation long, whitened double, explained double, identity_error double").select(F.lit(None).cast(kind).alias(id_col), *names)
    v, length = jacobi(tsqr(rows, d, n, s))
    bounded_batches(spark)
    k = int(min(most, (length > length[0] * d * np.finfo(float).eps).sum()))
    share = length**2 / max((length**2).sum(), np.finfo(float).tiny)
    turn = v[:, :k] / (length[:k] / np.sqrt(n))

    def projected(vectors):
        y = centred(whole(vectors), n, s)
        return y, (y / n).astype(np.float64) @ turn

    def spread(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for x in some(batches):
            w = projected(x)[1]
            total += w.sum(axis=0)
            square += w.T @ w
        i, j = np.divmod(np.arange(k * k + k), max(k, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([square.ravel(), total]))], names=["i", "j", "x"])

    got = np.zeros((k + 1, k))
    for x in rows.select("v").mapInArrow(spread, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        got[x["i"], x["j"]] = x["x"]
    mean = got[k] / n
    error = float(np.abs(got[:k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))

    def run(batches):
        for b in (b for b in batches if b.num_rows):
            y, w = projected(matrix(b.column(1)))
            many = len(w)
            row = pa.array(np.repeat(np.arange(many), k))
            columns = [b.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n)), pa.array(deviations(y), pa.int64()).take(row), pa.array(w.ravel()), pa.array(np.tile(share[:k], many)), pa.array(np.full(many * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *names])

    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, f"id {kind.simpleString()}, {schema}").withColumnRenamed("id", id_col)
