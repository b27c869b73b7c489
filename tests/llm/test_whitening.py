"""Whitening against exact sums and numpy's own decomposition."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colocus.llm import whitening
from colocus.llm.common import shared_folder

FOLDER = "/root/testdata/sf0.001"


def held_to(got, vectors, components=32):
    """All columns of a result (pandas) against the definition; vectors maps vec_id to entries."""
    ids = sorted(vectors)
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in vectors[i]] for i in ids]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    away = {i: sum((n * v - t) ** 2 for v, t in zip(r, s, strict=True)) for i, r in zip(ids, x, strict=True)}
    y = np.array([[float(Fraction(n * v - t, n)) for v, t in zip(r, s, strict=True)] for r in x])
    v = y.T @ y / n
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(components, d)
    assert len(got) == n * k and set(got.component) == set(range(1, k + 1)) and (got.n == n).all()
    assert all(got.deviation == [away[i] for i in got.vec_id])
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    share = got.groupby("component").explained.first().to_numpy()
    assert share == pytest.approx(e[:k] / e.sum(), rel=1e-6)
    w = wide - wide.mean(axis=0)
    error = np.abs(w.T @ w / n - np.eye(k)).max()
    assert error < 1e-8 and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8
    back = np.linalg.lstsq(y, wide, rcond=None)[0] * np.sqrt(share * e.sum())  # the components themselves
    assert np.abs(v @ back - back * e[:k]).max() < 1e-6 * e[0]


def test_whole_table(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    held_to(whitening.op12_whitening(spark, FOLDER).toPandas(), vectors)


def test_awkward_rows(spark):
    r = np.random.default_rng(5)
    vectors = {i: (r.normal(size=5) * [1, 1e-2, 30, 5, 1]).tolist() for i in range(40)}
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [nan] * 5), (104, [inf, 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0, 0.0])]
    rows = [(i, v, 9, "x") for i, v in [*vectors.items(), *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component string").repartition(40)
    held_to(whitening.whiten(df, shared_folder(spark, "w")).toPandas(), vectors)
    again = [sorted(map(tuple, whitening.whiten(df.repartition(parts), shared_folder(spark, "w")).collect())) for parts in (1, 40)]
    assert [x[:4] for x in again[0]] == [x[:4] for x in again[1]]
    assert np.allclose([x[4] for x in again[0]], [x[4] for x in again[1]], atol=1e-9)
    assert whitening.whiten(df.limit(0), shared_folder(spark, "w")).count() == 0
    assert whitening.whiten(df.filter("vec_id >= 100 AND vec_id < 105"), shared_folder(spark, "w")).count() == 0


def test_ties_repeats_and_components_without_variance(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [3.0, 2.0, 0.5]), (4, [5.0, 2.0, 0.25])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shared_folder(spark, "w")).toPandas()
    assert len(got) == 12 and got.vec_id.isna().sum() == 3
    assert got[got.component == 3].whitened.isna().all() and got[got.component < 3].whitened.notna().all()
    assert got.identity_error.max() < 1e-9 and (got[got.component == 3].explained.abs() < 1e-12).all()
    alone = whitening.whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), shared_folder(spark, "w")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(c, 1, 0, None, None, None) for c in (1, 2, 3)]


def test_large_entries_have_exact_deviations(spark):
    rows = [(1, [2.0**20, 0.0]), (2, [-(2.0**20), 1.0]), (3, [2.0**40, 1.0]), (4, [0.0, 3.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shared_folder(spark, "w")).collect()}
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    away = [sum((4 * v - sum(r[j] for r in x)) ** 2 for j, v in enumerate(r)) for r in x]
    assert got == {i: a if a < 2**63 else None for (i, _), a in zip(rows, away, strict=True)}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10_000))
def test_jacobi_keeps_small_eigenvalues(d, seed):
    r = np.random.default_rng(seed)
    scale = 10.0 ** r.integers(-6, 7, size=d)
    b = r.normal(size=(d + 3, d))
    a = (b.T @ b) * np.outer(scale, scale)
    e, v = whitening.cyclic_jacobi(a)
    assert (np.diff(e) <= 0).all() and np.abs(v.T @ v - np.eye(d)).max() < 1e-12
    assert np.abs(v @ np.diag(e) @ v.T - a).max() <= 1e-12 * np.abs(a).max()
    inverse = np.linalg.inv(b.T @ b) / np.outer(scale, scale)  # its largest eigenvalue is one over the smallest of a
    assert 1 / e[-1] == pytest.approx(np.linalg.eigvalsh(inverse)[-1], rel=1e-6)


def test_all_pairs_turn_once_a_sweep():
    for d in range(2, 12):
        turns = whitening._turns(d)
        assert sorted((int(a), int(b)) for p, q in turns for a, b in zip(p, q, strict=True)) == [(a, b) for a in range(d) for b in range(a + 1, d)]
        assert all(len({*p.tolist(), *q.tolist()}) == 2 * len(p) for p, q in turns)
