"""Tails and quantiles of the normal, Student and binomial distributions.

Spark has no distribution functions, so these run in Arrow batches on rows that are
already aggregated: one row per test, never one per value.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

ALTERNATIVES = ("two-sided", "less", "greater")


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_upper(z: np.ndarray) -> np.ndarray:
    """P(Z > z), accurate far into the tail."""
    return np.array([0.5 * math.erfc(v / math.sqrt(2.0)) for v in np.asarray(z, dtype=float)])


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """log(gamma(a + 1/2) / gamma(a)), by an asymptotic series where the difference cancels."""
    out = np.empty_like(a)
    for i, v in enumerate(a):
        if v < 100:
            out[i] = math.lgamma(v + 0.5) - math.lgamma(v)
        else:
            out[i] = 0.5 * math.log(v) - 1 / (8 * v) + 1 / (192 * v**3) - 1 / (640 * v**5)
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, for x below (a+1)/(a+b+2)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    active = np.ones(x.shape, dtype=bool)
    m = 0
    while active.any():
        m += 1
        if m > 10_000_000:
            raise ArithmeticError("the continued fraction of the incomplete beta function did not converge")
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            total = np.where(active, total * step, total)
        active = active & (np.abs(step - 1.0) > 1e-16)
        if m > 50:
            active = active & (np.abs(step - 1.0) > 4e-16)
    return total


def student_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    a, b = df / 2.0, np.full_like(df, 0.5)
    x = df / (df + t * t)
    y = t * t / (df + t * t)
    log_beta = 0.5 * math.log(math.pi) - _log_gamma_step(a)  # log B(a, 1/2)
    with np.errstate(divide="ignore"):
        front = np.exp(-a * np.log1p(t * t / df) + 0.5 * np.log(y) - log_beta)
    straight = x < (a + 1.0) / (a + b + 2.0)
    low = np.where(straight, x, 0.0)
    high = np.where(straight, 0.0, y)
    # P(|T| > |t|) as the incomplete beta function at x, taken from the side that converges.
    both = np.where(
        straight,
        front * _beta_fraction(a, b, low) / a,
        1.0 - front * _beta_fraction(b, a, high) / b,
    )
    return np.where(t >= 0, both / 2.0, 1.0 - both / 2.0)


def student_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """The t with P(T <= t) = p, for p above 1/2, by bisection on the upper tail."""
    df = np.asarray(df, dtype=float)
    low, high = np.zeros_like(df), np.full_like(df, 2.0)
    while (beyond := student_upper(high, df) > 1.0 - p).any():
        high = np.where(beyond, high * 2.0, high)
    for _ in range(200):
        mid = (low + high) / 2.0
        if ((mid <= low) | (mid >= high)).all():
            break
        over = student_upper(mid, df) > 1.0 - p
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    return (low + high) / 2.0


def _binomial_upper(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    a, b, x = float(k), float(n - k + 1), p
    log_front = (
        math.lgamma(n + 1.0) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * float(_beta_fraction(*map(np.atleast_1d, (a, b, x)))[0]) / a
    lower = math.exp(log_front) * float(_beta_fraction(*map(np.atleast_1d, (b, a, 1.0 - x)))[0]) / b
    return 1.0 - lower


def _binomial_lower(k: int, n: int, p: float) -> float:
    """P(X <= k): the failures' upper tail, so that small values keep their digits."""
    return 1.0 if k >= n else _binomial_upper(n - k, n, 1.0 - p)


def _log_pmf(k: int, n: int, p: float) -> float:
    return (
        math.lgamma(n + 1.0) - math.lgamma(k + 1.0) - math.lgamma(n - k + 1.0)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )


def binomial_p(k: int, n: int, p: float, alternative: str) -> float:
    """The exact binomial p-value.

    Two-sided it sums every outcome that is no likelier than ``k``, up to a relative
    error of 1e-7; outcomes grow less likely away from the mode, so the far end is
    found by bisection and its tail summed in closed form.
    """
    if alternative == "greater":
        return _binomial_upper(k, n, p)
    if alternative == "less":
        return _binomial_lower(k, n, p)
    mode = min(n, int((n + 1) * p))
    limit = _log_pmf(k, n, p) + math.log1p(1e-7)
    if _log_pmf(mode, n, p) <= limit:
        return 1.0
    if k < mode:
        low, high = mode, n + 1  # smallest i above the mode that is as unlikely as k
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (low, mid) if _log_pmf(mid, n, p) <= limit else (mid, high)
        tails = _binomial_lower(k, n, p) + _binomial_upper(high, n, p)
    else:
        low, high = -1, mode  # largest i below the mode that is as unlikely as k
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if _log_pmf(mid, n, p) <= limit else (low, mid)
        tails = _binomial_upper(k, n, p) + (_binomial_lower(low, n, p) if low >= 0 else 0.0)
    return min(1.0, tails)


def _one_or_two(upper: np.ndarray, statistic: np.ndarray, alternative: str, tail) -> np.ndarray:
    if alternative == "greater":
        return upper
    if alternative == "less":
        return tail(-statistic)
    return np.minimum(1.0, 2.0 * tail(np.abs(statistic)))


def _on_known(size: int, known: np.ndarray, compute) -> pd.Series:
    out = np.full(size, np.nan)
    if known.any():
        out[known] = compute()
    return pd.Series(out).astype(object).where(known, None)


def student_p_value(alternative: str):
    """A pandas UDF (statistic, df) -> p-value; NULL where either is missing."""

    def p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
        known = (statistic.notna() & (df > 0)).to_numpy()
        s, d = statistic.to_numpy(float)[known], df.to_numpy(float)[known]
        return _on_known(
            len(known), known,
            lambda: _one_or_two(student_upper(s, d), s, alternative, lambda v: student_upper(v, d)),
        )

    return F.pandas_udf(p_value, "double")


def student_critical(alpha: float):
    """A pandas UDF df -> two-sided critical value."""

    def critical(df: pd.Series) -> pd.Series:
        known = (df > 0).to_numpy()
        d = df.to_numpy(float)[known]
        return _on_known(len(known), known, lambda: student_quantile(1.0 - alpha / 2.0, d))

    return F.pandas_udf(critical, "double")


def normal_p_value(alternative: str):
    """A pandas UDF statistic -> p-value."""

    def p_value(statistic: pd.Series) -> pd.Series:
        known = statistic.notna().to_numpy()
        s = statistic.to_numpy(float)[known]
        return _on_known(
            len(known), known, lambda: _one_or_two(normal_upper(s), s, alternative, normal_upper)
        )

    return F.pandas_udf(p_value, "double")


def binomial_p_value(p0: float, alternative: str):
    """A pandas UDF (successes, n) -> exact p-value."""

    def p_value(successes: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(
            [binomial_p(int(k), int(m), p0, alternative) if m > 0 else None
             for k, m in zip(successes, n)],
            dtype=object,
        )

    return F.pandas_udf(p_value, "double")
