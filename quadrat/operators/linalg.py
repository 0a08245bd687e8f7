"""Small matrices (features x features) fitted by one Spark aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import number


@dataclass(frozen=True)
class Moments:
    """Row count, column means and the sample covariance of complete rows."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray


def complete_rows(df: DataFrame, columns: Sequence[str]) -> Column:
    """Condition: every column holds a number."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & number(name).isNotNull()
    return condition


def fit_moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Means and covariance (n-1) from a single aggregate; p x p numbers come back."""
    p = len(columns)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    rows = df.filter(complete_rows(df, columns)).select(*[number(c).alias(c) for c in columns])
    row = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.covar_samp(columns[i], columns[j]) for i, j in upper]).alias("cov"),
    ).first()
    cov = np.full((p, p), np.nan)
    for (i, j), value in zip(upper, row["cov"], strict=True):
        cov[i, j] = cov[j, i] = np.nan if value is None else value
    mean = np.array([np.nan if v is None else v for v in row["mean"]])
    return Moments(tuple(columns), row["n"], mean, cov)


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a covariance; singular matrices get the pseudo-inverse."""
    try:
        return np.linalg.inv(matrix)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(matrix)


def linear(columns: Sequence[str], weights: Sequence[float], shift: Sequence[float]) -> Column:
    """``sum(weight * (column - shift))`` as a plain expression."""
    total = None
    for name, w, s in zip(columns, weights, shift, strict=True):
        term = (number(name) - F.lit(float(s))) * F.lit(float(w))
        total = term if total is None else total + term
    return total
