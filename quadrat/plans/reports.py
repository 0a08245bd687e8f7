"""Whole-data-set reports composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import categorical_names, melt, numeric_names
from quadrat.operators import hypotheses, profile
from quadrat.operators.multivariate import pca_outliers


def dataset_report(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing, distinct, most frequent, mean, std, range."""
    types = df.sparkSession.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, feature string, type string"
    )
    missing = profile.missing_table(df, clip_zero=False).select(
        "feature", F.col("total").alias("rows"), "missing"
    )
    frequent = profile.categorical_profile(df, df.columns).select(
        "feature", F.col("unique").alias("distinct"), "top", "freq"
    )
    numeric = numeric_names(df)
    report = types.join(missing, "feature").join(frequent, "feature", "left")
    if numeric:
        numbers = profile.moments(df, numeric).select("feature", "mean", "std", "min", "max")
        report = report.join(numbers, "feature", "left")
    return report.withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def dataset_associations(df: DataFrame, numeric=None, category=None) -> DataFrame:
    """``(x, y, kind, value)``: correlation, correlation ratio, uncertainty coefficient."""
    numeric = list(numeric if numeric is not None else numeric_names(df))
    category = list(category if category is not None else categorical_names(df))
    parts = []
    if len(numeric) > 1:
        parts.append(
            profile.correlation_pairs(df, numeric).select(
                "x", "y", F.lit("correlation").alias("kind"), F.col("r").alias("value")
            )
        )
    if numeric:
        parts += [
            profile.correlation_ratio(df, c, numeric).select(
                F.col("category").alias("x"), F.col("feature").alias("y"),
                F.lit("correlation ratio").alias("kind"), F.col("eta").alias("value"),
            )
            for c in category
        ]
    parts += [
        profile.uncertainty_coefficient(df, a, b).select(
            "x", "y", F.lit("uncertainty").alias("kind"), F.col("u").alias("value")
        )
        for a in category
        for b in category
        if a != b
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionAll(part)
    return table


def compare_datasets(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, count_a, count_b, missing_…, mean_…, std_…, mean_delta)`` in one pass."""
    both = first.select(*columns, F.lit("a").alias("side")).unionByName(
        second.select(*columns, F.lit("b").alias("side"))
    )
    stats = melt(both, columns, ["side"]).groupBy("feature", "side").agg(
        F.count("value").alias("count"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    sides = [
        F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{m}_{s}")
        for m in ("count", "missing", "mean", "std")
        for s in ("a", "b")
    ]
    table = stats.groupBy("feature").agg(*sides)
    return table.withColumn("mean_delta", F.col("mean_b") - F.col("mean_a"))


def anova_report(df: DataFrame, y: str, group: str, confidence: float = 0.95) -> dict[str, DataFrame]:
    """Analysis of variance with group means, comparisons and assumption checks."""
    alpha = 1 - confidence
    left = hypotheses.residuals(df.select(y, group).dropna(), y, group)
    return {
        "anova": hypotheses.anova_oneway(df, y, group),
        "groups": profile.group_interval(df, y, group, confidence),
        "comparisons": hypotheses.tukey_hsd(df, y, group, alpha),
        "normality": hypotheses.normality_tests(left, "residual", confidence),
        "variances": hypotheses.equal_variance_tests(left, "residual", group, confidence),
    }


def assumptions_verdict(report: dict[str, DataFrame]) -> DataFrame:
    """``(assumption, holds)``: normality by Jarque-Bera, equal variances by Levene."""
    normal = report["normality"].filter("test = 'Jarque-Bera'").select(
        F.lit("normal residuals").alias("assumption"), F.col("normal").alias("holds")
    )
    equal = report["variances"].filter("test = 'Levene'").select(
        F.lit("equal variances").alias("assumption"), F.col("equal_var").alias("holds")
    )
    return normal.unionAll(equal)


def outlier_chart(
    df: DataFrame, columns: Sequence[str], label: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Component scores with both outlier flags and the class, for 2-D and 3-D charts."""
    return pca_outliers(df, columns, [*keep, label])
