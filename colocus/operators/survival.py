"""Time-to-event kernels in numpy: partial likelihood, ridge and elastic-net Cox, preprocessing fit on training rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


class Diverged(ArithmeticError):
    """A fit left the range of finite numbers."""


def _risk_sums(time: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values over all subjects with at least each subject's time. Rows come sorted by time."""
    tail = np.cumsum(values[::-1], axis=0)[::-1]
    return tail[np.searchsorted(time, time, side="left")]


def log_likelihood(x: np.ndarray, time: np.ndarray, event: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray]:
    """Breslow's partial log-likelihood and its gradient."""
    o = np.argsort(time, kind="stable")
    x, time, event = x[o], time[o], event[o].astype(bool)
    eta = x @ beta
    top = eta.max(initial=0.0)
    w = np.exp(eta - top)
    s0, s1 = _risk_sums(time, w), _risk_sums(time, w[:, None] * x)
    value = float(np.sum(eta[event] - top - np.log(s0[event])))
    return value, (x[event] - s1[event] / s0[event, None]).sum(axis=0)


def ridge_cox(x: np.ndarray, time: np.ndarray, event: np.ndarray, alpha: float = 0.0, steps: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Maximises the log-likelihood less alpha / 2 times the squared norm, by Newton steps that are halved while they do not help."""
    o = np.argsort(time, kind="stable")
    x, time, event = np.asarray(x, float)[o], np.asarray(time, float)[o], np.asarray(event)[o].astype(bool)
    p = x.shape[1]
    beta, best = np.zeros(p), -np.inf
    cross = (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)
    for _ in range(steps):
        eta = x @ beta
        w = np.exp(eta - eta.max(initial=0.0))
        s0, s1 = _risk_sums(time, w), _risk_sums(time, w[:, None] * x)
        s2 = _risk_sums(time, w[:, None] * cross)[event].reshape(-1, p, p)
        mean = s1[event] / s0[event, None]
        gradient = (x[event] - mean).sum(axis=0) - alpha * beta
        hessian = (s2 / s0[event, None, None] - mean[:, :, None] * mean[:, None, :]).sum(axis=0) + alpha * np.eye(p)
        if best == -np.inf:
            best = log_likelihood(x, time, event, beta)[0] - alpha / 2 * beta @ beta
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        for _ in range(30):
            trial = beta + step
            now = log_likelihood(x, time, event, trial)[0] - alpha / 2 * trial @ trial
            if np.isfinite(now) and now >= best - 1e-12:
                break
            step = step / 2
        if not np.isfinite(now):
            raise Diverged("the partial likelihood is not finite")
        moved, beta, gain, best = float(np.abs(step).max(initial=0.0)), beta + step, now - best, now
        if moved < tolerance or 0 <= gain < 1e-13 * abs(best):
            break
    return beta


def elastic_net_descent(x: np.ndarray, time: np.ndarray, event: np.ndarray, alphas: np.ndarray, l1: float, factor: np.ndarray, sweeps: int = 5_000, tolerance: float = 1e-9) -> Iterator[np.ndarray]:
    """Coefficients for one penalty after the other, largest first, each started from the one before; ends where a fit diverges.

    Minimises minus the log-likelihood over n plus alpha * sum factor * (l1 |b| +
    (1 - l1) / 2 b^2): the likelihood is replaced by a weighted square around
    the current risk and solved by coordinate descent, until neither moves.
    """
    o = np.argsort(time, kind="stable")
    x, time, event = np.asarray(x, float)[o], np.asarray(time, float)[o], np.asarray(event)[o].astype(bool)
    n, p = x.shape
    beta = np.zeros(p)
    last = np.searchsorted(time, time, side="right") - 1
    for alpha in alphas:
        for _ in range(200):
            eta = x @ beta
            w = np.exp(eta - eta.max(initial=0.0))
            s0 = _risk_sums(time, w)
            a, b = (np.cumsum(np.where(event, 1 / s0**k, 0.0))[last] for k in (1, 2))
            gradient, curve = event - w * a, np.maximum(w * a - w * w * b, 1e-9)
            target = eta + gradient / curve
            before, start = beta.copy(), beta.copy()
            products = (x * curve[:, None]).T @ x / n  # sweeps need no rows: what a move takes from the others' pull is in here
            pulls = (x.T @ (curve * (target - eta))) / n
            for _ in range(sweeps):
                widest = 0.0
                for k in range(p):
                    square = float(products[k, k])
                    pull = float(pulls[k] - products[k] @ (beta - start)) + square * beta[k]
                    cut = alpha * l1 * factor[k]
                    new = np.sign(pull) * max(abs(pull) - cut, 0.0) / (square + alpha * (1 - l1) * factor[k]) if square > 0 else 0.0
                    if new != beta[k]:
                        widest = max(widest, abs(new - beta[k]))
                        beta[k] = new
                if widest < tolerance:
                    break
            if not np.isfinite(beta).all() or np.abs(x @ beta).max(initial=0.0) > 500:
                return
            if np.abs(beta - before).max(initial=0.0) < tolerance * 10:
                break
        yield beta.copy()


def elastic_net_path(x: np.ndarray, time: np.ndarray, event: np.ndarray, alphas: np.ndarray, l1: float, factor: np.ndarray, sweeps: int = 5_000, tolerance: float = 1e-9) -> np.ndarray:
    """Coefficients by penalty as columns; NaN from the first penalty on at which the descent diverges."""
    out = np.full((x.shape[1], len(alphas)), np.nan)
    for j, beta in enumerate(elastic_net_descent(x, time, event, alphas, l1, factor, sweeps, tolerance)):
        out[:, j] = beta
    return out


def penalties(x: np.ndarray, time: np.ndarray, event: np.ndarray, l1: float, factor: np.ndarray, count: int = 20, ratio: float = 0.01) -> np.ndarray:
    """From the smallest penalty that keeps all penalised coefficients at zero down to ``ratio`` times it, log-spaced."""
    beta, free = np.zeros(x.shape[1]), factor == 0
    if free.any():
        beta[free] = ridge_cox(x[:, free], time, event)
    gradient = np.abs(log_likelihood(x, np.asarray(time, float), np.asarray(event), beta)[1]) / len(x)
    top = float((gradient[~free] / factor[~free]).max(initial=0.0)) / max(l1, 1e-3) or 1.0
    return np.geomspace(top, top * ratio, count)


@dataclass(frozen=True)
class FeatureSet:
    """Columns of a model by block; the spatial block may be taken beyond what composition explains."""

    name: str
    clinical: tuple[str, ...]
    composition: tuple[str, ...] = ()
    spatial: tuple[str, ...] = ()
    beyond_composition: bool = False

    def __post_init__(self) -> None:
        if self.beyond_composition and not self.composition:
            raise ValueError("spatial features beyond composition need composition columns")

    @property
    def columns(self) -> tuple[str, ...]:
        return self.clinical + self.composition + self.spatial

    @property
    def factor(self) -> np.ndarray:
        return np.r_[np.zeros(len(self.clinical)), np.ones(len(self.composition) + len(self.spatial))]


def log_ratios(counts: np.ndarray, pseudocount: float = 0.5) -> np.ndarray:
    log = np.log(counts + pseudocount)
    return log - log.mean(axis=1, keepdims=True)


class Preparation:
    """Imputation, log-ratios, residuals and scaling of a feature set; all parameters come from the training rows."""

    def __init__(self, features: FeatureSet, x: np.ndarray, pseudocount: float = 0.5):
        self.features, self.pseudocount = features, pseudocount
        a, b = len(features.clinical), len(features.clinical) + len(features.composition)
        self.cuts = (a, b)
        known = np.ones_like(x, bool)
        known[:, :a], known[:, b:] = ~np.isnan(x[:, :a]), ~np.isnan(x[:, b:])
        self.median = np.array([np.median(x[known[:, j], j]) if known[:, j].any() else 0.0 for j in range(x.shape[1])])
        if features.beyond_composition:
            filled = self._filled(x)
            z = self._explaining(filled)
            self.s_mean, self.z_mean = filled[:, b:].mean(axis=0), z.mean(axis=0)
            self.slope = np.linalg.lstsq(z - self.z_mean, filled[:, b:] - self.s_mean, rcond=None)[0]
        raw = self._raw(x)
        self.mean, sd = raw.mean(axis=0), raw.std(axis=0)
        self.sd = np.where(sd > 1e-12, sd, 1.0)

    def _filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.median, x)

    def _explaining(self, x: np.ndarray) -> np.ndarray:
        counts = x[:, self.cuts[0] : self.cuts[1]]
        return np.c_[log_ratios(counts, self.pseudocount), np.log(counts.sum(axis=1) + 1)]

    def _raw(self, x: np.ndarray) -> np.ndarray:
        a, b = self.cuts
        x = self._filled(x)
        spatial = x[:, b:]
        if self.features.beyond_composition:
            spatial = spatial - self.s_mean - (self._explaining(x) - self.z_mean) @ self.slope
        middle = log_ratios(x[:, a:b], self.pseudocount) if b > a else x[:, a:b]
        return np.c_[x[:, :a], middle, spatial]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self._raw(np.asarray(x, float)) - self.mean) / self.sd


def concordance(time: np.ndarray, event: np.ndarray, risk: np.ndarray, tied: float = 1e-8) -> float:
    """Harrell's C in n log n. NaN without a comparable pair.

    The order of (time, events first) is halved bit by bit: a pair meets in one
    node, i in its lower and j in its upper half, where j are counted by risk.
    """
    n, event = len(time), np.asarray(event, bool)
    if not n:
        return float("nan")
    levels = np.unique(risk)
    place = np.cumsum(np.r_[0, np.diff(levels) > tied])[np.searchsorted(levels, risk)]
    key = 2 * np.unique(time, return_inverse=True)[1].reshape(-1) + ~event
    order = np.argsort(place, kind="stable")
    good = pairs = 0
    for bit in reversed(range(int(key.max()).bit_length())):
        node, own = key[order] >> (bit + 1), place[order]
        upper = (key[order] >> bit) & 1
        count = np.r_[0, np.cumsum(upper)]
        new = np.r_[True, node[1:] != node[:-1]]
        run = new | np.r_[True, own[1:] != own[:-1]]
        starts, run_starts = np.flatnonzero(new), np.flatnonzero(run)
        of, of_run = np.cumsum(new) - 1, np.cumsum(run) - 1
        ends, run_ends = np.r_[starts[1:], n], np.r_[run_starts[1:], n]
        asked = event[order] & (upper == 0)
        before = count[starts][of[asked]]
        good += int((count[run_starts] + count[run_ends])[of_run[asked]].sum() - 2 * before.sum())
        pairs += int((count[ends][of[asked]] - before).sum())
        order = order[np.argsort(key[order] >> bit, kind="stable")]
    return good / 2 / pairs if pairs else float("nan")
