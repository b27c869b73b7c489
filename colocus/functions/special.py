"""Tails of the usual test distributions, without a statistics library."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d)
            c = 1.0 + term / c
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def sign_tail(x: int, n: int) -> float:
    """Chance of x or more successes among n at even odds."""
    if x <= 0 or x > n:
        return 1.0 if x <= 0 else 0.0
    return beta_share(x, n - x + 1.0, 0.5)


@F.pandas_udf(DoubleType())
def sign_tails(x: pd.Series, n: pd.Series) -> pd.Series:
    """sign_tail of whole columns."""
    return pd.Series([sign_tail(int(a), int(b)) for a, b in zip(x, n, strict=True)], dtype=float)


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if not f > 0 or df1 <= 0 or df2 <= 0:
        return 1.0 if f <= 0 else math.nan
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The value below which Student's t lies with chance p (0.5 < p < 1), by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def chi2_tail_1(x: float) -> float:
    """P(chi-squared with one degree of freedom > x)."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))
