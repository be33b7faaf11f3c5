"""Special functions that Spark lacks, on numpy arrays: log-gamma, erfc, incomplete gamma and beta, Fisher's exact test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
erfc = np.vectorize(math.erfc, otypes=[float])


def lgamma(x):
    return _lgamma(np.asarray(x, float))


def gamma_p(s: float, z: float) -> float:
    """The regularised lower incomplete gamma function."""
    if z <= 0:
        return 0.0
    if z > s + 1:
        return 1 - gamma_q(s, z)
    term = total = 1 / s
    for k in range(1, 1000):
        term *= z / (s + k)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(s * math.log(z) - z - math.lgamma(s))


def gamma_q(s: float, z: float) -> float:
    """The upper one, by a continued fraction."""
    if z <= s + 1:
        return 1 - gamma_p(s, z)
    b, tiny = z + 1 - s, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 1000):
        a = -k * (k - s)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(s * math.log(z) - z - math.lgamma(s))


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, on arrays (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones_like(y), 1 / (1 - (p + q) * y / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / (1 + num * d)
                c = 1 + num / c
                h = h * c * d
            if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-15:
                break
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def f_sf(f: np.ndarray, d1: float, d2: np.ndarray) -> np.ndarray:
    """The upper tail of the F distribution."""
    return beta_i(np.asarray(d2) / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float, float]:
    """Left, right and two-sided p of a 2 x 2 table."""
    r, k, n = a + b, a + c, a + b + c + d
    x = np.arange(max(0, r + k - n), min(r, k) + 1)
    lp = lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1)
    p = np.exp(lp)
    own = p[x == a][0]
    return min(1.0, float(p[x <= a].sum())), min(1.0, float(p[x >= a].sum())), min(1.0, float(p[p <= own * (1 + 1e-7)].sum()))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("left", "right", "two")]))
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fisher(*map(int, t)) for t in zip(a, b, c, d)], columns=["left", "right", "two"])


@F.pandas_udf(T.DoubleType())
def f_test(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(), d1.to_numpy(), d2.to_numpy()))
