"""Whitening of embeddings: exact sums, a distributed centred scatter, cyclic Jacobi on the driver.

The driver holds matrices of dimension times dimension only; rows never leave
their partitions. Partial matrices travel in blocks of rows and meet in a tree
of fixed fan-in, so that no task holds more than a few blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.llm.common import batches_of, lean, saved, shared_folder

SCALE, SHIFT = 64, 1_000_000
#: Entries whose whole number would not fit in a long are no numbers here.
LARGEST = 2.0**61 / SCALE
BATCH_BYTES = 4 << 20
#: Partial matrices that meet in one task, and bytes of one block of rows.
FAN_IN, BLOCK_BYTES = 32, 1 << 20
MOST_COMPONENTS = 32
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """True for a vector that is there, has entries, and of which every entry is there and finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda e: e.isNotNull() & (F.abs(e) < F.lit(LARGEST))), F.lit(False))


def whole(batch: pa.Table) -> np.ndarray:
    """The vectors of a batch as whole numbers, one row each; all have the same length."""
    flat = pc.list_flatten(batch.column("embedding").combine_chunks()).to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(batch.num_rows, -1)


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x, as Python's numbers where results of up to ``most`` would not fit in 63 bits."""
    return x if most < 2**63 else x.astype(object)


def _sums(rows: DataFrame) -> DataFrame:
    """d, i, n, s: for each length of vectors how many there are, and their sum by place."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches_of(stream, BATCH_BYTES):
            lengths = pc.list_value_length(batch.column("embedding").combine_chunks()).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                x = whole(batch.filter(pa.array(lengths == d)))
                s = exact(x, int(np.abs(x).max()) * len(x)).sum(axis=0).astype(object)
                n, before = found.get(d, (0, 0))
                found[d] = (n + len(x), s + before)
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], names=["d", "i", "n", "s"]
            )

    parts = rows.mapInArrow(lean(run), "d int, i int, n long, s decimal(38,0)")
    return parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def _summed(rows: DataFrame, of: Callable[[pa.Table], np.ndarray], shape: tuple[int, int], parts: int) -> np.ndarray:
    """The sum of ``of(batch)`` over all batches, each a matrix of the shape.

    Each partition adds its own up and sends them on in blocks of rows; blocks
    meet in a tree, in the order of the partitions, so that a repeated task
    gives the same digits.
    """
    height = max(1, BLOCK_BYTES // (8 * shape[1]))
    names, schema = ["block", "part", "values"], "block int, part int, values binary"

    def out(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in found], pa.int32()), pa.array([p for _, p, _ in found], pa.int32()), pa.array([v.tobytes() for _, _, v in found], pa.binary())], names=names)

    def own(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches_of(stream, BATCH_BYTES):
            total = of(batch) if total is None else total + of(batch)
        if total is not None:
            part = TaskContext.get().partitionId()
            yield out([(b, part, total[low : low + height]) for b, low in enumerate(range(0, shape[0], height))])

    def meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for batch in stream:
            for b, p, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((b, p // FAN_IN), []).append((p, v))
        for (b, p), own_ in held.items():
            total = 0.0
            for _, v in sorted(own_):
                total = total + np.frombuffer(v)
            yield out([(b, p, total)])

    blocks = -(-shape[0] // height)
    found = rows.mapInArrow(lean(own), schema)
    while parts > 1:
        groups = -(-parts // FAN_IN)
        found = found.repartition(max(1, groups * blocks), "block", F.floor(F.col("part") / FAN_IN)).mapInArrow(lean(meet), schema)
        parts = groups
    rows_of = {b: np.frombuffer(bytes(v)).reshape(-1, shape[1]) for b, _, v in found.collect()}
    return np.concatenate([rows_of[b] for b in sorted(rows_of)]) if rows_of else np.zeros(shape)


def _turns(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d places in rounds of disjoint pairs, as in a tournament."""
    ring, rounds = list(range(d + d % 2)), []
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1], strict=True) if max(a, b) < d]
        rounds.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def cyclic_jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite matrix.

    A sweep turns every pair of axes once, in rounds of disjoint pairs. A pair
    counts as settled when its entry is below rounding beside the two diagonal
    entries, not beside the largest one: that keeps small eigenvalues accurate.
    The largest entry of each vector is positive.
    """
    a, d = np.array(matrix, float), len(matrix)
    vectors, eps = np.eye(d), np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in _turns(d):
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            live = np.abs(off) > eps * np.sqrt(np.abs(dp * dq)) + np.finfo(float).tiny
            if not live.any():
                continue
            turned = True
            p, q, off, dp, dq = p[live], q[live], off[live], dp[live], dq[live]
            tau = (dq - dp) / (2 * off)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
            c = 1 / np.hypot(1, t)
            s = t * c
            for m in (a.T, a, vectors.T):  # columns of a, its rows, columns of the vectors
                left, right = m[p], m[q]
                m[p], m[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp - t * off, dq + t * off
        if not turned:
            break
    order = np.argsort(-a.diagonal(), kind="stable")
    vectors = vectors[:, order]
    return a.diagonal()[order], vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


def whiten(table: DataFrame, folder: str, components: int = MOST_COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    table needs vec_id and embedding; other columns are left out. Null vectors,
    empty ones and those with a null, NaN, infinite or over 2**55 entry go. If
    lengths differ, the most frequent one counts (the longer of equals) and
    vectors of other lengths go. Repeated rows stay and count each time; a null
    vec_id stays null. A component without variance has a null ``whitened`` and
    no part in identity_error; ``explained`` is null if no component has any.
    A deviation beyond a long is null. No usable vector gives no rows.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")))
    sums = saved(_sums(rows.select("embedding")), f"{folder}/sums")
    first = sums.filter("i = 0").orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    d, n = first["d"], first["n"]
    s = np.array([int(r["s"]) for r in sums.filter(F.col("d") == d).orderBy("i").collect()], object)
    rows = rows.filter(F.size("embedding") == d)
    base = (s // n).astype(np.int64)  # the mean's whole part, and what is left of n times it
    left = (s - n * base).astype(np.int64)
    rest = left / n

    def centred(batch: pa.Table) -> np.ndarray:
        return (whole(batch) - base) - rest

    def scatter(batch: pa.Table) -> np.ndarray:
        y = centred(batch)
        return y.T @ y

    parts = rows.rdd.getNumPartitions()
    covariance = _summed(rows.select("embedding"), scatter, (d, d), parts) / n
    e, vectors = cyclic_jacobi((covariance + covariance.T) / 2)
    k, trace = min(components, d), float(covariance.trace())
    real = e[:k] > d * np.finfo(float).eps * max(e[0], 0.0)
    matrix = vectors[:, :k] / np.sqrt(np.where(real, e[:k], 1.0))  # d * k numbers go to every task

    def products(batch: pa.Table) -> np.ndarray:
        w = centred(batch) @ matrix
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(rows.select("embedding"), products, (k + 1, k), parts) / n
    found = found[:-1] - np.outer(found[-1], found[-1])
    kept = np.flatnonzero(real)
    error = float(np.abs(found[np.ix_(kept, kept)] - np.eye(len(kept))).max()) if len(kept) else None
    share = (e[:k] / trace).tolist() if trace > 0 else [None] * k

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(stream, BATCH_BYTES):
            m = batch.num_rows
            x = whole(batch) - base
            most = n * (int(np.abs(x).max()) + 1)
            away = exact(x, d * most * most) * n - exact(left, d * most * most)
            away = (away * away).sum(axis=1).tolist()
            w = ((x - rest) @ matrix).reshape(-1)
            ids = batch.column("vec_id").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array([v if v < 2**63 else None for v in away], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w, mask=np.tile(~real, m)), pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(lean(run), SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), shared_folder(spark, "op12"))
