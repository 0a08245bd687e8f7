"""Distribution functions for p-values and critical values.

numpy kernels, used on driver scalars and, through Arrow, on the small
aggregate tables (one row per group, feature or principal component).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()
_TINY = 1e-300


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def normal_sf(x):
    """P(Z > x)."""
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    """Quantile of the standard normal."""
    return _NORMAL.inv_cdf(p)


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    """P(chi-square(df) > x)."""
    return _gamma_q(df / 2.0, x / 2.0)


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_inc(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d or _TINY)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + even * d or _TINY)
        c = 1 + even / c or _TINY
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + odd * d or _TINY)
        c = 1 + odd / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def f_sf(x: float, df1: float, df2: float) -> float:
    """P(F(df1, df2) > x)."""
    return 1.0 if x <= 0 else _beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))


def t_sf(x: float, df: float) -> float:
    """P(T(df) > x)."""
    tail = 0.5 * _beta_inc(df / 2, 0.5, df / (df + x * x))
    return tail if x >= 0 else 1.0 - tail


def _solve(survival, target: float, low: float, high: float) -> float:
    """Root of a decreasing survival function by bisection."""
    while survival(high) > target:
        low, high = high, high * 2
    for _ in range(200):
        mid = 0.5 * (low + high)
        if survival(mid) > target:
            low = mid
        else:
            high = mid
        if high - low <= 1e-14 * max(1.0, abs(high)):
            break
    return 0.5 * (low + high)


def chi2_ppf(p: float, df: float) -> float:
    """Quantile of the chi-square distribution."""
    return _solve(lambda x: chi2_sf(x, df), 1 - p, 0.0, df + 10.0)


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t distribution."""
    if p < 0.5:
        return -t_ppf(1 - p, df)
    return _solve(lambda x: t_sf(x, df), 1 - p, 0.0, 10.0)


def _legendre(order: int, low: float, high: float):
    nodes, weights = np.polynomial.legendre.leggauss(order)
    half = (high - low) / 2
    return nodes * half + (high + low) / 2, weights * half


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) for the range of k means with df error degrees of freedom."""
    if q <= 0:
        return 1.0
    z, wz = _legendre(256, -8.0, 8.0)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = normal_sf(-z)

    def range_cdf(width):
        lower = normal_sf(-(z[None, :] - np.atleast_1d(width)[:, None]))
        return k * ((upper - lower).clip(0) ** (k - 1) * phi * wz).sum(axis=1)

    if df > 25_000:
        return float(min(1.0, max(0.0, 1 - range_cdf(q)[0])))
    spread = 10.0 / math.sqrt(2 * df)
    s, ws = _legendre(256, max(1e-8, 1 - spread), 1 + spread)
    if df < 20:
        s, ws = _legendre(512, 1e-8, 1 + 12.0 / math.sqrt(2 * df))
    log_density = (
        math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
        + (df - 1) * np.log(s) - df * s * s / 2
    )
    return float(min(1.0, max(0.0, 1 - (np.exp(log_density) * ws * range_cdf(q * s)).sum())))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    """Critical value of the studentised range."""
    return _solve(lambda x: studentized_range_sf(x, k, df), 1 - p, 0.0, 10.0)


def _elementwise(function):
    """Lift a scalar function to an Arrow UDF over double columns; NULL stays NULL."""

    def apply(*columns: pd.Series) -> pd.Series:
        rows = zip(*[c.to_numpy(dtype=float) for c in columns], strict=True)
        return pd.Series(
            [None if any(v != v for v in row) else function(*row) for row in rows],
            dtype="float64",
        )

    return apply


def _column(function, *columns) -> Column:
    kernel = _elementwise(function)
    if len(columns) == 1:
        def udf(a: pd.Series) -> pd.Series:
            return kernel(a)
    elif len(columns) == 2:
        def udf(a: pd.Series, b: pd.Series) -> pd.Series:
            return kernel(a, b)
    else:
        def udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return kernel(a, b, c)
    lifted = F.pandas_udf(udf, "double")
    return lifted(
        *[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in columns]
    )


def erfc_column(x: Column) -> Column:
    """Complementary error function, the one piece Spark SQL does not have."""

    def kernel(values: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(v) for v in values], dtype="float64")

    return F.pandas_udf(kernel, "double")(x)


def chi2_sf_column(x: Column, df: int) -> Column:
    """chi-square survival for a whole number of degrees of freedom.

    Both closed forms are plain expressions; odd degrees also need one erfc.
    """
    half = x / 2.0
    if df % 2 == 0:
        term = total = F.lit(1.0)
        for i in range(1, df // 2):
            term = term * half / float(i)
            total = total + term
        return F.exp(-half) * total
    total = erfc_column(F.sqrt(half))
    for j in range(1, (df - 1) // 2 + 1):
        total = total + F.exp(-half) * F.pow(half, F.lit(j - 0.5)) / math.gamma(j + 0.5)
    return total


def f_sf_column(x, df1, df2) -> Column:
    """Column form of :func:`f_sf`."""
    return _column(f_sf, x, df1, df2)


def t_ppf_column(p, df) -> Column:
    """Column form of :func:`t_ppf`."""
    return _column(lambda a, b: t_ppf(a, b) if b > 0 else None, p, df)


def normal_sf_column(x) -> Column:
    """Column form of :func:`normal_sf`."""
    return _column(lambda a: 0.5 * math.erfc(a / math.sqrt(2.0)), x)


def normal_ppf_column(p) -> Column:
    """Column form of :func:`normal_ppf`."""
    return _column(normal_ppf, p)


def studentized_range_sf_column(q, k, df) -> Column:
    """Column form of :func:`studentized_range_sf`."""
    return _column(lambda a, b, c: studentized_range_sf(a, int(b), c), q, k, df)
