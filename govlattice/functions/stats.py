"""Tail probabilities for statistics that Spark has already reduced to a few rows.

The heavy part (counting, ranking, summing) is done by DataFrame operators; the
functions here turn one finished statistic into one p-value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_KS_LIMIT = 10_000


def chi2_tail(x: float, dof: int) -> float:
    """P(X > x) for a chi-square variable, by the finite recurrence in dof."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2 == 0:
        total, term, k = 0.0, math.exp(-half), 0
        steps = dof // 2
    else:
        total = math.erfc(math.sqrt(half))
        term, k = math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 0.5
        steps = (dof - 1) // 2
    for _ in range(steps):
        total += term
        k += 1
        term *= half / k
    return min(1.0, total)


def _ks_limit_tail(d: float, n1: int, n2: int) -> float:
    """Kolmogorov's limit law with a small-sample shift of the argument."""
    en = round(n1 * n2 / (n1 + n2))
    root = math.sqrt(en)
    x = root * d + 1.0 / (6.0 * root) + (root * d - 1.0) / (4.0 * en)
    if x <= 0.2:
        return 1.0
    total = 0.0
    for k in range(1, 101):
        term = math.exp(-2.0 * k * k * x * x)
        total += term if k % 2 else -term
        if term < 1e-18:
            break
    return min(1.0, max(0.0, 2.0 * total))


def _ks_same_size_tail(h: int, n: int) -> float:
    """Exact tail for two samples of n: reflection sum of binomial ratios."""
    total, k = 0.0, 1
    while k * h <= n:
        log_ratio = 2 * math.lgamma(n + 1) - math.lgamma(n - k * h + 1) - math.lgamma(n + k * h + 1)
        total += math.exp(log_ratio) if k % 2 else -math.exp(log_ratio)
        k += 1
    return min(1.0, max(0.0, 2.0 * total))


def _ks_lattice_tail(h: int, n1: int, n2: int) -> float:
    """Exact tail by counting the lattice paths that stay inside the band.

    ``h`` is the statistic times n1*n2/gcd. A row of path counts is the running
    sum of the row before, restricted to the band; rows are rescaled and the
    scale kept as a logarithm.
    """
    g = math.gcd(n1, n2)
    a, b = n1 // g, n2 // g
    heights = np.arange(n2 + 1) * a
    paths = np.zeros(n2 + 1)
    paths[0] = 1.0
    log_scale = 0.0
    for i in range(n1 + 1):
        inside = np.abs(i * b - heights) < h
        paths = np.where(inside, np.cumsum(np.where(inside, paths, 0.0)), 0.0)
        top = paths.max()
        if top == 0.0:
            return 1.0
        paths /= top
        log_scale += math.log(top)
    if paths[n2] == 0.0:
        return 1.0
    log_all = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    staying = math.exp(math.log(paths[n2]) + log_scale - log_all)
    return min(1.0, max(0.0, 1.0 - staying))


def ks_tail(d: float, n1: int, n2: int) -> float:
    """Two-sided two-sample tail: exact up to 10,000 values a side, then the limit."""
    if d <= 0:
        return 1.0
    if max(n1, n2) > EXACT_KS_LIMIT:
        return _ks_limit_tail(d, n1, n2)
    g = math.gcd(n1, n2)
    h = round(d * (n1 // g) * n2)
    if h == 0:
        return 1.0
    if n1 == n2:
        return _ks_same_size_tail(h, n1)
    return _ks_lattice_tail(h, n1, n2)


def _chi2_series(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(v) or k < 1 else chi2_tail(float(v), int(k)) for v, k in zip(x, dof)],
        dtype="float64",
    )


def _ks_series(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(v) else ks_tail(float(v), int(a), int(b))
            for v, a, b in zip(d, n1, n2)
        ],
        dtype="float64",
    )


def chi2_p(x: Column, dof: Column) -> Column:
    return F.pandas_udf(_chi2_series, "double")(x, dof)


def ks_p(d: Column, n1: Column, n2: Column) -> Column:
    return F.pandas_udf(_ks_series, "double")(d, n1, n2)
