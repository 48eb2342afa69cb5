"""Statistics of counts: point probabilities as plain columns, tails of distributions as Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The coefficients of Lanczos's approximation for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def ln_gamma(x: Column) -> Column:
    """Of x >= 1."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def ln_choose(n: Column, k: Column) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return ln_gamma(n + 1.0) - ln_gamma(k + 1.0) - ln_gamma(n - k + 1.0)


def fisher_point(m1: Column, u1: Column, m2: Column, u2: Column) -> Column:
    """The probability of this 2 x 2 table given its margins; 1 if both samples are empty."""
    return F.exp(ln_choose(m1 + u1, m1) + ln_choose(m2 + u2, m2) - ln_choose(m1 + u1 + m2 + u2, m1 + m2))


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    z = x - 1
    series = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(series)


def chi_square_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X >= x) of the chi-square distribution: the incomplete gamma function by series or continued fraction."""
    x, a = np.asarray(x, float) / 2, np.asarray(df, float) / 2
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    low = ok & (x > 0) & (x < a + 1)
    if low.any():
        y, b = x[low], a[low]
        term = total = 1 / b
        for i in range(1, 2000):
            term = term * y / (b + i)
            total = total + term
            if (term < total * 1e-16).all():
                break
        out[low] = 1 - total * np.exp(-y + b * np.log(y) - _ln_gamma(b + 1) + np.log(b))
    high = ok & (x >= a + 1)
    if high.any():
        y, b = x[high], a[high]
        tiny = 1e-300
        d = 1 / np.maximum(y + 1 - b, tiny)
        c, h, at = np.full(y.shape, 1 / tiny), d.copy(), y + 1 - b
        for i in range(1, 2000):
            step = -i * (i - b)
            at = at + 2
            d = 1 / np.where(np.abs(step * d + at) < tiny, tiny, step * d + at)
            c = np.where(np.abs(at + step / c) < tiny, tiny, at + step / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = np.exp(-y + b * np.log(y) - _ln_gamma(b + 1) + np.log(b)) * h
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + step * d)
            c = guard(1 + step / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return np.where(np.abs(d * c - 1) < 1e-9, h, np.nan)  # no value where it doesn't settle


def f_tail(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    """P(X >= f) of the F distribution: the incomplete beta function."""
    f, d1, d2 = (np.asarray(v, float) for v in (f, df1, df2))
    out = np.full(f.shape, np.nan)
    ok = (d1 > 0) & (d2 > 0) & (f >= 0)
    if not ok.any():
        return out
    f, a, b = f[ok], d2[ok] / 2, d1[ok] / 2
    x = d2[ok] / (d2[ok] + d1[ok] * f)
    ln_beta = lambda p, q: _ln_gamma(p + 1) - np.log(p) + _ln_gamma(q + 1) - np.log(q) - (_ln_gamma(p + q + 1) - np.log(p + q))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - ln_beta(a, b))
        low = x < (a + 1) / (a + b + 2)
        found = np.where(low, front * _beta_fraction(a, b, x) / a, 1 - front * _beta_fraction(b, a, 1 - x) / b)
    out[ok] = np.where(x >= 1, 1.0, np.where(x <= 0, 0.0, found))
    return out


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi_square_tail(x.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))).replace({np.nan: None}).astype(float)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_tail(*(v.to_numpy(float, na_value=np.nan) for v in (f, df1, df2)))).astype(float)


def pruned_chi_square(meth: np.ndarray, unmeth: np.ndarray, allowed: np.ndarray | None = None, least: float = 5.0) -> tuple[float, int, int]:
    """(chi-square, degrees of freedom, samples left): samples whose expected counts under the pooled share are below
    least, or that aren't allowed, are dropped and the share is pooled anew until nothing changes."""
    m, u = np.asarray(meth, float), np.asarray(unmeth, float)
    use = np.ones(len(m), bool) if allowed is None else np.asarray(allowed, bool).copy()
    while use.sum() >= 2:
        n = m + u
        total = n[use].sum()
        share = m[use].sum() / total if total else 0.0
        keep = use & (n * share >= least) & (n * (1 - share) >= least)
        if (keep == use).all():
            e1, e2 = n[use] * share, n[use] * (1 - share)
            return float((((m[use] - e1) ** 2) / e1 + ((u[use] - e2) ** 2) / e2).sum()), int(use.sum()) - 1, int(use.sum())
        use = keep
    return 0.0, 0, int(use.sum())


def fixed(x: Column, places: int) -> Column:
    """x with so many places, rounded by its exact binary value, as C prints it; JVM formatting rounds decimal halves up."""

    @F.pandas_udf(T.StringType())
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda y: None if pd.isna(y) else f"{y:.{places}f}")

    return text(x.cast("double"))
