"""Nested cross-validation, transfer and resampling as task tables: each row of tasks is fitted on one executor."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from colocus.operators import survival as S


@dataclass(frozen=True)
class Settings:
    outer: int = 5
    inner: int = 5
    l1: float = 0.5
    count: int = 20
    ratio: float = 0.01
    ridge: tuple[float, float] = (-2.0, 3.0)
    pseudocount: float = 0.5


def fold_of(ids: np.ndarray, event: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """Fold of each subject: within events and non-events, the order of the md5 of seed and id is dealt round."""
    out = np.zeros(len(ids), np.int64)
    key = np.array([hashlib.md5(f"{seed}-{i}".encode()).hexdigest() for i in ids])
    for value in (False, True):
        at = np.flatnonzero(event.astype(bool) == value)
        out[at[np.lexsort((ids[at], key[at]))]] = np.arange(len(at)) % folds
    return out


class Ladder:
    """All penalties of one feature set on one training set, fitted in a single descent.

    alphas falls; beta has a column for each, NaN where no fit was reached, and
    ``reached`` is the index of the last penalty with a fit (-1: none). Ridge
    penalties are fitted apart from each other, so a gap does not end them.
    """

    def __init__(self, features: S.FeatureSet, x: np.ndarray, time: np.ndarray, event: np.ndarray, alphas: np.ndarray, s: Settings):
        self.alphas = alphas
        if features.factor.any():
            self.beta = S.elastic_net_path(x, time, event, alphas, s.l1, features.factor, tolerance=1e-6)
        else:
            self.beta = np.column_stack([_ridge(x, time, event, a) for a in alphas])
        self.fits = np.flatnonzero(np.isfinite(self.beta).all(axis=0))
        self.reached = int(self.fits[-1]) if len(self.fits) else -1

    @property
    def whole(self) -> bool:
        return len(self.fits) == len(self.alphas)


def _ridge(x: np.ndarray, time: np.ndarray, event: np.ndarray, alpha: float) -> np.ndarray:
    try:
        return S.ridge_cox(x, time, event, alpha)
    except (S.Diverged, np.linalg.LinAlgError):
        return np.full(x.shape[1], np.nan)


def grid(features: S.FeatureSet, x: np.ndarray, time: np.ndarray, event: np.ndarray, s: Settings) -> np.ndarray:
    """Penalties, largest first: fixed ones for ridge, else the deepest of the ranges (each half as deep as the one before) that fits to its end."""
    if not features.factor.any():
        return np.logspace(*reversed(s.ridge), s.count)
    depths = (s.ratio * 2.0**k for k in range(int(np.ceil(-np.log2(s.ratio)))))
    ranges = (S.penalties(x, time, event, s.l1, features.factor, s.count, depth) for depth in depths)
    found = next((alphas for alphas in ranges if Ladder(features, x, time, event, alphas, s).whole), None)
    if found is None:
        raise S.Diverged("no penalty grid fits")
    return found


def path(features: S.FeatureSet, x: np.ndarray, time: np.ndarray, event: np.ndarray, alphas: np.ndarray, s: Settings) -> np.ndarray:
    """Coefficients by penalty, NaN where there is no fit."""
    return Ladder(features, x, time, event, alphas, s).beta


def chosen(features: S.FeatureSet, x: np.ndarray, time: np.ndarray, event: np.ndarray, ids: np.ndarray, seed: int, s: Settings) -> tuple[float, float, np.ndarray]:
    """The penalty with the best mean C of the inner folds (the largest on ties), that mean, and the grid."""
    alphas = grid(features, S.Preparation(features, x, s.pseudocount)(x), time, event, s)
    fold = fold_of(ids, event, s.inner, seed)
    c = np.full((s.inner, len(alphas)), np.nan)
    for f in range(s.inner):
        train, test = fold != f, fold == f
        ready = S.Preparation(features, x[train], s.pseudocount)
        beta = path(features, ready(x[train]), time[train], event[train], alphas, s)
        for j in np.flatnonzero(np.isfinite(beta).all(axis=0)):
            c[f, j] = S.concordance(time[test], event[test], ready(x[test]) @ beta[:, j])
    mean = np.array([np.nanmean(col) if np.isfinite(col).any() else -np.inf for col in c.T])
    j = int(mean.argmax())
    return float(alphas[j]), float(mean[j]), alphas


def final_fit(features: S.FeatureSet, x: np.ndarray, time: np.ndarray, event: np.ndarray, alpha: float, alphas: np.ndarray, s: Settings) -> tuple[S.Preparation, np.ndarray, float]:
    """Fit on all rows at the penalty, reached from the larger ones; where the descent ends before, its last fit."""
    ready = S.Preparation(features, x, s.pseudocount)
    above = alphas[alphas > alpha] if features.factor.any() else alphas[:0]
    ladder = Ladder(features, ready(x), time, event, np.append(above, alpha), s)
    if ladder.reached < 0:
        raise S.Diverged("no penalty fits")
    return ready, ladder.beta[:, ladder.reached], float(ladder.alphas[ladder.reached])


def _frame(pdf: pd.DataFrame, features: S.FeatureSet, id_: str) -> tuple[np.ndarray, ...]:
    pdf = pdf.sort_values(id_)
    return pdf[id_].to_numpy(), pdf[list(features.columns)].to_numpy(float), pdf["time"].to_numpy(float), pdf["event"].to_numpy(bool)


OOF = "model string, seed long, fold long, id long, risk double, alpha double, alpha_fitted double, inner_c double, n_nonzero long, coefficients array<double>"


def nested_cv(spark: SparkSession, subjects: pd.DataFrame, models: list[S.FeatureSet], seeds: list[int], settings: Settings | None = None, id_: str = "id", shuffle_spatial: int | None = None) -> DataFrame:
    """Out-of-fold risks: one task for each model, seed and outer fold.

    subjects is the cohort (a row per subject, thousands at most) and goes with
    the tasks. The outer folds of a seed are the same for all models. With
    ``shuffle_spatial`` the rows of the spatial block are first moved together
    to other subjects.
    """
    s = settings or Settings()
    tasks = spark.createDataFrame([(i, seed, k) for i in range(len(models)) for seed in seeds for k in range(s.outer)], "model_index int, seed long, fold long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, seed, k in pdf[["model_index", "seed", "fold"]].itertuples(index=False):
            f = models[i]
            rows = subjects
            if shuffle_spatial is not None and f.spatial:
                rows = permuted_block(subjects, id_, list(f.spatial), shuffle_spatial)
            ids, x, time, event = _frame(rows, f, id_)
            fold = fold_of(ids, event, s.outer, seed)
            train, test = fold != k, fold == k
            alpha, inner, alphas = chosen(f, x[train], time[train], event[train], ids[train], seed * 1000 + k, s)
            ready, beta, fitted = final_fit(f, x[train], time[train], event[train], alpha, alphas, s)
            risk = ready(x[test]) @ beta
            omics = int((np.abs(beta[len(f.clinical) :]) > 1e-10).sum())
            out += [(f.name, seed, k, int(j), float(r), alpha, fitted, inner, omics, beta.tolist()) for j, r in zip(ids[test], risk, strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in OOF.split(", ")])

    return tasks.groupBy("model_index", "seed", "fold").applyInPandas(run, OOF)


def permuted_block(subjects: pd.DataFrame, id_: str, columns: list[str], seed: int) -> pd.DataFrame:
    """The given columns moved together to other subjects, by the order of the md5 of seed and id."""
    rows = subjects.sort_values(id_).reset_index(drop=True)
    key = [hashlib.md5(f"{seed}-{i}".encode()).hexdigest() for i in rows[id_]]
    moved = rows.copy()
    moved[columns] = rows.loc[np.argsort(key, kind="stable"), columns].to_numpy()
    return moved


def transfer(spark: SparkSession, train: pd.DataFrame, test: pd.DataFrame, models: list[S.FeatureSet], seed: int, settings: Settings | None = None, id_: str = "id") -> DataFrame:
    """Fit each model once on one cohort and score the other: model, id, risk, alpha."""
    s = settings or Settings()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i in pdf["model_index"]:
            f = models[i]
            ids, x, time, event = _frame(train, f, id_)
            alpha, _, alphas = chosen(f, x, time, event, ids, seed, s)
            ready, beta, _ = final_fit(f, x, time, event, alpha, alphas, s)
            other, x2, _, _ = _frame(test, f, id_)
            out += [(f.name, int(j), float(r), alpha) for j, r in zip(other, ready(x2) @ beta, strict=True)]
        return pd.DataFrame(out, columns=["model", "id", "risk", "alpha"])

    tasks = spark.createDataFrame([(i,) for i in range(len(models))], "model_index int")
    return tasks.groupBy("model_index").applyInPandas(run, "model string, id long, risk double, alpha double")


def random_risks(subjects: pd.DataFrame, seed: int, id_: str = "id") -> np.ndarray:
    """Risks without information: a number from the md5 of seed and id."""
    return np.array([int(hashlib.md5(f"{seed}/{i}".encode()).hexdigest()[:12], 16) / 16.0**12 for i in subjects[id_]])


def calibration_slope(time: np.ndarray, event: np.ndarray, risk: np.ndarray) -> float:
    """The coefficient of a Cox model on the risk alone: 1 if its spread is right."""
    return float(S.ridge_cox(np.asarray(risk, float)[:, None], time, event)[0])


def td_auc(time: np.ndarray, event: np.ndarray, risk: np.ndarray, at: float) -> float:
    """Cumulative/dynamic AUC at a time, cases weighted by the inverse chance of being uncensored by then. NaN without cases or controls."""
    times, place, n = np.unique(time, return_inverse=True, return_counts=True)
    d = np.bincount(place[~event.astype(bool)], minlength=len(times))
    g = np.cumprod(1 - d / np.cumsum(n[::-1])[::-1])
    case, control = event.astype(bool) & (time <= at), time > at
    if not case.any() or not control.any():
        return float("nan")
    chance = g[place[case]]
    w = np.where(chance > 0, 1 / np.where(chance > 0, chance, 1), 0.0)
    below = np.sort(risk[control])
    score = (np.searchsorted(below, risk[case], side="left") + np.searchsorted(below, risk[case], side="right")) / 2
    return float((w * score).sum() / (w.sum() * len(below)))


def resampled_metrics(spark: SparkSession, subjects: pd.DataFrame, risks: dict[str, np.ndarray], times: list[float], samples: int, seed: int) -> DataFrame:
    """(sample, model, metric, value): calibration slope and AUCs on the whole cohort (sample -1) and on resamples.

    All models share a resample; a resample on which a metric fails has no row for it.
    """
    time, event = subjects["time"].to_numpy(float), subjects["event"].to_numpy(bool)
    n = len(time)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in pdf["sample"]:
            at = np.arange(n)
            if b >= 0:
                at = np.array([int(hashlib.md5(f"{seed}-{b}-{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)])
            if not event[at].any():
                continue
            for name, risk in risks.items():
                values = {"slope": calibration_slope(time[at], event[at], risk[at])} | {f"auc_{t:g}": td_auc(time[at], event[at], risk[at], t) for t in times}
                out += [(int(b), name, m, v) for m, v in values.items() if np.isfinite(v)]
        return pd.DataFrame(out, columns=["sample", "model", "metric", "value"])

    tasks = spark.range(-1, samples).withColumnRenamed("id", "sample")
    return tasks.repartition(max(1, samples // 8), "sample").mapInPandas(lambda it: map(run, it), "sample long, model string, metric string, value double")
