"""Univariate and multivariate outlier detection."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import melt, number, numeric_names
from quadrat.functions.distributions import chi2_ppf, chi2_sf_column
from quadrat.operators.linalg import complete_rows, fit_moments, inverse, linear
from quadrat.operators.quantiles import column_deviations, quantile_table

METHODS = ("iqr", "zscore", "mad")


def univariate_limits(
    df: DataFrame,
    columns: Sequence[str],
    methods: Sequence[str] = METHODS,
    k: float = 1.5,
    zscore: float = 3.0,
    mad: float = 3.5,
) -> DataFrame:
    """``(method, feature, low, high)``: a value outside [low, high] is an outlier.

    All three rules are intervals: quartiles -+ k IQR; mean -+ z population
    deviations; median -+ 3.5/0.6745 median deviations (with a zero deviation
    every value off the median is out, as the interval is one point).
    """
    tables = []
    if "iqr" in methods or "mad" in methods:
        # one row per column; the medians are needed as literals for the deviations
        quartiles = quantile_table(df, columns, [0.25, 0.5, 0.75]).collect()
        q = df.sparkSession.createDataFrame(
            [(r["feature"], r["q0"], r["q1"], r["q2"]) for r in quartiles],
            "feature string, q1 double, median double, q3 double",
        )
    if "iqr" in methods:
        reach = k * (F.col("q3") - F.col("q1"))
        tables.append(_limits(q, "iqr", F.col("q1") - reach, F.col("q3") + reach))
    if "zscore" in methods:
        cells = [
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(number(c)).alias("m"),
                F.stddev_pop(number(c)).alias("s"),
            )
            for c in columns
        ]
        m = df.agg(F.array(*cells).alias("__c")).select(F.inline("__c")).filter("s > 0")
        reach = zscore * F.col("s")
        tables.append(_limits(m, "zscore", F.col("m") - reach, F.col("m") + reach))
    if "mad" in methods:
        d = q.join(column_deviations(df, {r["feature"]: r["q1"] for r in quartiles}), "feature")
        reach = mad / 0.6745 * F.col("deviation")
        tables.append(_limits(d, "mad", F.col("median") - reach, F.col("median") + reach))
    limits = tables[0]
    for table in tables[1:]:
        limits = limits.unionAll(table)
    return limits


def _limits(table: DataFrame, method: str, low: Column, high: Column) -> DataFrame:
    return table.select(
        F.lit(method).alias("method"), "feature", low.alias("low"), high.alias("high")
    )


def _outside(df: DataFrame, column: str, limits: DataFrame, key: str) -> DataFrame:
    bounds = limits.agg(F.first(F.struct("low", "high"))).scalar()
    value = number(column)
    return df.filter((value < bounds["low"]) | (value > bounds["high"])).select(
        key, value.alias("value")
    )


def iqr_outliers(df: DataFrame, column: str, key: str, k: float = 1.5) -> DataFrame:
    """``(key, value)`` strictly outside the quartiles by more than ``k`` IQR."""
    return _outside(df, column, univariate_limits(df, [column], ["iqr"], k=k), key)


def zscore_outliers(df: DataFrame, column: str, key: str, threshold: float = 3.0) -> DataFrame:
    """``(key, value)`` with a population z-score beyond the threshold."""
    limits = univariate_limits(df, [column], ["zscore"], zscore=threshold)
    return _outside(df, column, limits, key)


def mad_outliers(df: DataFrame, column: str, key: str, threshold: float = 3.5) -> DataFrame:
    """``(key, value)`` with a modified z-score beyond the threshold."""
    return _outside(df, column, univariate_limits(df, [column], ["mad"], mad=threshold), key)


def outlier_ratio(df: DataFrame, outliers: DataFrame) -> DataFrame:
    """One row ``(outliers, rows, ratio)``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return outliers.agg(F.count(F.lit(1)).alias("outliers")).select(
        "outliers",
        total.alias("rows"),
        F.try_divide(F.col("outliers").cast("double"), total).alias("ratio"),
    )


def detect_univariate(
    df: DataFrame,
    categories: Sequence[str],
    key: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``(method, feature, key, value, categories…)``, all methods and columns at once.

    The limits (3 rows per column) are broadcast to one scan of the long form.
    """
    columns = columns or [c for c in numeric_names(df) if c not in (key, *categories)]
    limits = F.broadcast(univariate_limits(df, columns))
    long = melt(df, columns, [key, *categories]).filter("value is not null")
    beyond = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return (
        long.join(limits, "feature")
        .filter(beyond)
        .select("method", "feature", key, "value", *categories)
    )


def mahalanobis_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``mahalanobis_score``: squared distance to the column means.

    One aggregate fits means and covariance; the score itself is a plain
    quadratic form, so no row-by-row matrix exists. Incomplete rows get NULL.
    """
    fit = fit_moments(df, columns)
    weights = inverse(fit.cov)
    score = None
    for i, name in enumerate(columns):
        term = (number(name) - F.lit(float(fit.mean[i]))) * linear(columns, weights[i], fit.mean)
        score = term if score is None else score + term
    return df.withColumn("mahalanobis_score", score)


def mahalanobis_outliers(
    df: DataFrame, columns: Sequence[str], alpha: float = 0.01
) -> DataFrame:
    """Rows whose chi-square p-value is below ``alpha``, with score and p-value.

    The filter compares the score with the critical value, so it stays a plain
    expression; p-values are computed for the outliers only.
    """
    p = len(columns)
    scored = mahalanobis_score(df, columns)
    out = scored.filter(F.col("mahalanobis_score") > chi2_ppf(1 - alpha, p))
    score = F.col("mahalanobis_score")
    return out.withColumn("mahalanobis_p_value", chi2_sf_column(score, p))


def mahalanobis_pairs(df: DataFrame, columns: Sequence[str], radius: float) -> DataFrame:
    """Distances of the distinct value vectors that lie within ``radius`` of another.

    ``(left, right, rows_left, rows_right, distance)`` with left < right; equal
    rows are folded with their counts, so repeated vectors cost nothing. Vectors
    are whitened and hashed to grid cells of side ``radius``: a pair can only meet
    in neighbouring cells, which makes the search an equi-join on the cell.
    """
    fit = fit_moments(df, columns)
    whiten = np.linalg.cholesky(inverse(fit.cov)).T
    axes = [f"__z{i}" for i in range(len(columns))]
    folded = (
        df.filter(complete_rows(df, columns))
        .groupBy(*[number(c).alias(c) for c in columns])
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    points = folded.select(
        F.struct(*columns).alias("vector"),
        "rows",
        *[linear(columns, whiten[i], fit.mean).alias(a) for i, a in enumerate(axes)],
    )
    # the grid uses at most three axes; the distance test uses all of them
    grid = axes[:3]
    cell = [F.floor(F.col(a) / radius).cast("long") for a in grid]
    left = points.select("*", F.array(*cell).alias("cell"))
    around = F.array(
        *[
            F.array(*[c + F.lit(step) for c, step in zip(cell, steps, strict=True)])
            for steps in product((-1, 0, 1), repeat=len(grid))
        ]
    )
    right = points.select(
        F.col("vector").alias("vector_r"),
        F.col("rows").alias("rows_r"),
        *[F.col(a).alias(f"{a}r") for a in axes],
        F.explode(around).alias("cell"),
    )
    distance = F.sqrt(
        sum((F.pow(F.col(a) - F.col(f"{a}r"), F.lit(2.0)) for a in axes), F.lit(0.0))
    )
    return (
        left.join(right, "cell")
        .filter(F.col("vector") < F.col("vector_r"))
        .select(
            F.col("vector").alias("left"),
            F.col("vector_r").alias("right"),
            F.col("rows").alias("rows_left"),
            F.col("rows_r").alias("rows_right"),
            distance.alias("distance"),
        )
        .filter(F.col("distance") <= radius)
    )


def detect_multivariate(
    df: DataFrame,
    categories: Sequence[str],
    key: str,
    columns: Sequence[str] | None = None,
    alpha: float = 0.01,
    apply: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Mahalanobis outliers with their categories, and the table without them.

    Both results are filters on one score, so no join back by key is needed.
    With ``apply=False`` the second table keeps all rows.
    """
    columns = columns or [c for c in numeric_names(df) if c not in (key, *categories)]
    scored = mahalanobis_score(df, columns)
    limit = chi2_ppf(1 - alpha, len(columns))
    is_outlier = F.coalesce(F.col("mahalanobis_score") > limit, F.lit(False))
    outliers = scored.filter(is_outlier).select(key, *categories, *columns, "mahalanobis_score")
    kept = scored.filter(~is_outlier) if apply else scored
    return outliers, kept.drop("mahalanobis_score")
