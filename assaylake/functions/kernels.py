"""Numpy kernels for the distributions Spark has no built-in for, and their column functions.

Formulas: Abramowitz & Stegun 6.3/6.4 (digamma, trigamma), 26.5.8 with Lentz's method (incomplete
beta), Wichura's AS 241 (normal quantile), Smyth 2004 (inverse trigamma).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def vectorized(schema: str):
    """A pandas UDF made on first use, so that the module loads without a Spark session."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(schema)(f)(*columns)

        return call

    return wrap


_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_upper(z: np.ndarray) -> np.ndarray:
    """P(Z > z) for a standard normal."""
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2.0))


def normal_pdf(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, dtype=float)
    return np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The standard normal quantile: bisection on the tail, polished by Newton steps."""
    p = np.atleast_1d(np.asarray(p, dtype=float))
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1.0 - normal_upper(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    z = (lo + hi) / 2
    z = np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, z))
    return np.where((p < 0) | (p > 1) | np.isnan(p), np.nan, z)



def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift - 1 / np.where(low, x, 1.0), shift)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132)))))
    return shift + np.log(x) - 0.5 / x - series


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift + 1 / np.where(low, x * x, 1.0), shift)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    series = (1 / x) * (1 + 0.5 / x + r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66))))))
    return shift + series


def trigamma_inverse(t: np.ndarray) -> np.ndarray:
    """y with trigamma(y) = t; infinite at 0. Bisection on ln y, trigamma falling in y."""
    t = np.atleast_1d(np.asarray(t, dtype=float))
    lo, hi = np.full(t.shape, -20.0), np.full(t.shape, 25.0)
    for _ in range(120):
        mid = (lo + hi) / 2
        above = trigamma(np.exp(mid)) > t
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    out = np.exp((lo + hi) / 2)
    return np.where(t == 0, np.inf, np.where((t < 0) | np.isnan(t), np.nan, out))


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    safe = lambda u: np.where(np.abs(u) < tiny, tiny, u)
    c = np.ones_like(x)
    d = 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        d = 1 / safe(1 + even * d)
        c = safe(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        d = 1 / safe(1 + odd * d)
        c = safe(1 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    x, a, b = np.broadcast_arrays(*(np.asarray(u, dtype=float) for u in (x, a, b)))
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(xs) + b * np.log1p(-xs))
    direct = xs < (a + 1) / (a + b + 2)
    left = front * _beta_fraction(np.where(direct, xs, 1e-9), a, b) / a
    right = 1 - front * _beta_fraction(np.where(direct, 1e-9, 1 - xs), b, a) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(direct, left, right)))


def t_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for Student's t; normal where df is infinite."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    out = np.full(t.shape, np.nan)
    good = ~np.isnan(t) & (df > 0)
    normal = good & (np.isinf(df) | (df > 1e7))
    if normal.any():
        out[normal] = normal_upper(t[normal])
    student = good & ~normal
    if student.any():
        ts, ds = t[student], df[student]
        half = 0.5 * incomplete_beta(ds / (ds + ts * ts), ds / 2, 0.5)
        out[student] = np.where(ts < 0, 1 - half, half)
    return out


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """The p-quantile of Student's t for each df (p above one half), by bisection."""
    df = np.asarray(df, dtype=float)
    uniq, inverse = np.unique(np.where(np.isnan(df), -1.0, df), return_inverse=True)
    out = np.full(uniq.shape, np.nan)
    good = uniq > 0
    if good.any():
        d = uniq[good]
        lo, hi = np.zeros_like(d), np.full_like(d, 1.0)
        while True:
            short = t_upper(hi, d) > 1 - p
            if not short.any():
                break
            hi = np.where(short, hi * 2, hi)
        for _ in range(100):
            mid = (lo + hi) / 2
            above = t_upper(mid, d) > 1 - p
            lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        out[good] = (lo + hi) / 2
    return out[inverse].reshape(df.shape)


@vectorized("double")
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of z."""
    return pd.Series(2 * normal_upper(np.abs(z.to_numpy(dtype=float))))


@vectorized("double")
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    return pd.Series(2 * t_upper(np.abs(t.to_numpy(dtype=float)), df.to_numpy(dtype=float)))


@vectorized("double")
def t_quantile_975(df: pd.Series) -> pd.Series:
    """The 97.5% quantile of Student's t (normal where df is infinite)."""
    return pd.Series(t_quantile(0.975, df.to_numpy(dtype=float)))


@vectorized("double")
def normal_upper_tail(z: pd.Series) -> pd.Series:
    return pd.Series(normal_upper(z.to_numpy(dtype=float)))


def padded(column: pd.Series, width: int | None = None) -> np.ndarray:
    """A column of number lists as a matrix, short rows filled with NaN."""
    rows = [np.asarray(r if r is not None else [], dtype=float) for r in column]
    k = width if width is not None else max((len(r) for r in rows), default=0)
    out = np.full((len(rows), k), np.nan)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


SeriesPair = Iterator[tuple[pd.Series, pd.Series]]
