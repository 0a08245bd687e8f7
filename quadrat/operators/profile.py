"""Column profiles, grouped summaries and pairwise association."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quadrat.functions.columns import (
    adjusted_kurtosis,
    adjusted_skewness,
    is_missing,
    melt,
    number,
    percent_of,
    pretty_label,
)
from quadrat.functions.distributions import t_ppf_column
from quadrat.operators.kendall import kendall_tau
from quadrat.operators.linalg import complete_rows
from quadrat.operators.quantiles import (
    MAD_SCALE,
    column_deviations,
    quantile_table,
    ranked_values,
)
from quadrat.operators.wide import WIDE_COLUMNS, wide_pairs


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, count, missing, mean, std, min, max, g1, g2)`` from one scan."""
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            F.count(number(name)).alias("count"),
            F.count_if(number(name).isNull()).alias("missing"),
            F.avg(number(name)).alias("mean"),
            F.stddev_samp(number(name)).alias("std"),
            F.min(number(name)).alias("min"),
            F.max(number(name)).alias("max"),
            F.skewness(number(name)).alias("g1"),
            F.kurtosis(number(name)).alias("g2"),
        )
        for name in columns
    ]
    return df.agg(F.array(*cells).alias("__c")).select(F.inline("__c"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: describe, variation, MAD, kurtosis, skewness.

    Moments stay in one generated-code aggregate of their own; a sketch in the
    same aggregate would slow them down. The medians found for the quartiles
    serve the deviations too.
    """
    quartiles = quantile_table(df, columns, [0.25, 0.5, 0.75]).collect()  # one row per column
    found = df.sparkSession.createDataFrame(
        [(r["feature"], r["q0"], r["q1"], r["q2"]) for r in quartiles],
        "feature string, p25 double, p50 double, p75 double",
    )
    deviations = column_deviations(df, {r["feature"]: r["q1"] for r in quartiles})
    small = moments(df, columns).join(F.broadcast(found), "feature", "left")
    return small.join(deviations, "feature", "left").select(
        "feature",
        pretty_label("feature").alias("label"),
        "count",
        "missing",
        "mean",
        "std",
        "min",
        "p25",
        "p50",
        "p75",
        "max",
        percent_of(F.col("std"), F.col("mean")).alias("pct_var"),
        (F.col("deviation") / F.lit(MAD_SCALE)).alias("mad"),
        adjusted_kurtosis(F.col("count"), F.col("g2")).alias("kurt"),
        adjusted_skewness(F.col("count"), F.col("g1")).alias("skew"),
    )


def feature_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, n)`` of non-null values as text, all columns in one pass."""
    long = melt(df, columns, as_text=True).filter("value is not null")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """``(feature, count, unique, top, freq)``; ties go to the smallest value.

    Counts are combined in two steps, per value and then per feature, so no task
    holds the distinct values of a column.
    """
    return counts.groupBy("feature").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its frequency per column."""
    return most_frequent(feature_value_counts(df, columns))


def missing_table(df: DataFrame, clip_zero: bool = True) -> DataFrame:
    """Missing values per column, largest first."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.count_if(~is_missing(df, name)).alias("present"),
                F.count_if(is_missing(df, name)).alias("missing"),
                F.count(F.lit(1)).alias("total"),
            )
            for name in df.columns
        ]
    )
    table = df.agg(cells.alias("__c")).select(F.inline("__c"))
    table = table.withColumn(
        "percent", percent_of(F.col("missing").cast("double"), F.col("total").cast("double"))
    )
    table = table.filter("missing > 0") if clip_zero else table
    return table.orderBy(F.col("missing").desc(), "feature")


def missing_matrix(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Presence flag of every cell, with the row's completeness, fullest rows first."""
    names = [c for c in df.columns if c not in keys]
    flags = [(~is_missing(df, c)).cast("int").alias(c) for c in names]
    full = sum((F.col(c) for c in names), F.lit(0)).cast("int").alias("completeness")
    return df.select(*keys, *flags).select("*", full).orderBy(
        F.col("completeness").desc(), *keys
    )


def missing_patterns(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(pattern, completeness, rows)``: the matrix folded to its distinct rows."""
    names = [c for c in df.columns if c not in keys]
    bits = F.concat(*[(~is_missing(df, c)).cast("int").cast("string") for c in names])
    return (
        df.select(bits.alias("pattern"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("completeness", F.length(F.replace("pattern", F.lit("0"), F.lit(""))))
    )


AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_samp, "var": F.var_samp,
}


def pivot_to_aggregate(
    df: DataFrame,
    index: Sequence[str],
    columns: str | None,
    values: Sequence[str],
    aggs: Sequence[str],
    pivot_values: Sequence | None = None,
    fill=None,
) -> DataFrame:
    """Pivot table; NULL keys are dropped, empty cells get ``fill`` (NULL by default).

    Pass ``pivot_values`` to save the job that looks the pivot values up.
    """
    keys = [*index, *([columns] if columns else [])]
    grouped = df.dropna(subset=keys).groupBy(*index)
    if columns:
        grouped = grouped.pivot(columns, list(pivot_values) if pivot_values else None)
    table = grouped.agg(*[AGGREGATES[a](v).alias(f"{v}_{a}") for v in values for a in aggs])
    if len(values) * len(aggs) == 1 and columns:
        name = f"{values[0]}_{aggs[0]}"
        table = table.select(
            *index, *[F.col(f"`{c}`").alias(f"{c}_{name}") for c in table.columns if c not in index]
        )
    return table if fill is None else table.fillna(fill)


def group_mean_std(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Mean and sample deviation per group; groups without both are dropped."""
    return (
        df.dropna(subset=list(by))
        .groupBy(*by)
        .agg(F.avg(number(column)).alias("mean"), F.stddev_samp(number(column)).alias("std"))
        .na.drop(subset=["mean", "std"])
        .orderBy(*by)
    )


def group_count(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Non-null counts per group; NULL keys form their own group."""
    return df.groupBy(*by).agg(*[F.count(c).alias(c) for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("items"))
    return counts.orderBy(F.col("items").desc(), column)


def group_interval(df: DataFrame, y: str, group: str, confidence: float = 0.95) -> DataFrame:
    """N, mean, SD, SE and the t interval of the mean per group."""
    table = (
        df.filter(number(y).isNotNull())
        .dropna(subset=[group])
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(number(y)).alias("mean"),
            F.stddev_samp(number(y)).alias("sd"),
        )
        .withColumn("se", F.col("sd") / F.sqrt("n"))
    )
    half = t_ppf_column((1 + confidence) / 2, F.col("n") - 1) * F.col("se")
    return table.withColumn("__half", half).select(
        group, "n", "mean", "sd", "se",
        (F.col("mean") - F.col("__half")).alias("ci_low"),
        (F.col("mean") + F.col("__half")).alias("ci_high"),
    )


def _pair_cells(columns: Sequence[str], value, diagonal: bool) -> list[Column]:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i if diagonal else i + 1:]]
    return [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), value(a, b).alias("r"))
        for a, b in pairs
    ]


def pairwise(df: DataFrame, columns: Sequence[str], value, diagonal: bool = False) -> DataFrame:
    """``(x, y, r)`` of column pairs i<j (i<=j with ``diagonal``) from one aggregate."""
    cells = _pair_cells(columns, value, diagonal)
    return df.agg(F.array(*cells).alias("__c")).select(F.inline("__c"))


def _spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over the rows where both columns are present.

    Equal pairs are folded first; the mean rank is known, so one weighted
    aggregate over the folded pairs is enough.
    """
    complete = df.select(number(a).alias("a"), number(b).alias("b")).dropna()
    cells = complete.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    for side in ("a", "b"):
        ranks = ranked_values(complete, side).select(
            F.col("value").alias(side), F.col("rank").alias(f"rank_{side}")
        )
        cells = cells.join(ranks, side)
    centre = (complete.agg(F.count(F.lit(1))).scalar() + 1) / 2.0
    x, y, w = F.col("rank_a") - centre, F.col("rank_b") - centre, F.col("w")
    r = F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x) * F.sum(w * y * y)))
    return cells.agg(r.alias("r")).select(F.lit(a).alias("x"), F.lit(b).alias("y"), "r")


def _spearman_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs at once for columns without gaps: each column is ranked once."""
    ranked = df.select(*[number(c).alias(c) for c in columns])
    cells = ranked.groupBy(*columns).agg(F.count(F.lit(1)).alias("__w"))
    for name in columns:
        ranks = ranked_values(ranked, name).select(
            F.col("value").alias(name), F.col("rank").alias(f"__{name}")
        )
        cells = cells.join(ranks, name)
    centre = (ranked.agg(F.count(F.lit(1))).scalar() + 1) / 2.0

    def weighted(a: str, b: str) -> Column:
        x, y, w = F.col(f"__{a}") - centre, F.col(f"__{b}") - centre, F.col("__w")
        return F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x) * F.sum(w * y * y)))

    return pairwise(cells, columns, weighted)


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], method: str = "pearson"
) -> DataFrame:
    """Pairwise-complete correlation of every column pair i<j.

    ``spearman`` correlates average ranks, ``kendall`` is tau-b; both use every
    row.
    """
    if method == "pearson":
        if len(columns) > WIDE_COLUMNS:
            return wide_pairs(df, columns, "corr")
        return pairwise(df, columns, lambda a, b: F.corr(number(a), number(b)))
    if method == "spearman" and not df.filter(~complete_rows(df, columns)).head(1):
        return _spearman_complete(df, columns)
    rule = {"spearman": _spearman, "kendall": kendall_tau}.get(method)
    if rule is None:
        raise ValueError(f"unknown method {method!r}")
    return reduce(DataFrame.unionAll, [rule(df, a, b) for a, b in combinations(columns, 2)])


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], method: str = "pearson"
) -> DataFrame:
    """Full symmetric matrix in long form ``(x, y, r)``, ones on the diagonal."""
    pairs = correlation_pairs(df, columns, method)
    both = F.array(
        F.struct("x", "y", "r"),
        F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "r"),
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "x string")
    ones = names.select("x", F.col("x").alias("y"), F.lit(1.0).alias("r"))
    return pairs.select(F.inline(both)).unionAll(ones)


def correlation_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle ``(x, y, r)`` with display labels."""
    return correlation_pairs(df, columns).select(
        pretty_label("y").alias("x"), pretty_label("x").alias("y"), "r"
    )


def covariance_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariance of every column pair i<=j."""
    if len(columns) > WIDE_COLUMNS:
        return wide_pairs(df, columns, "cov")
    return pairwise(df, columns, lambda a, b: F.covar_samp(number(a), number(b)), diagonal=True)


def correlation_ratio(df: DataFrame, category: str, columns: Sequence[str]) -> DataFrame:
    """``(category, feature, eta)``: share of a number's spread between categories."""
    long = melt(df.dropna(subset=[category]), columns, [category]).filter("value is not null")
    groups = long.groupBy("feature", category).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    whole = W.partitionBy("feature")  # one row per category
    grand = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    gap = F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))
    table = groups.withColumn("grand", grand).groupBy("feature").agg(
        F.sum(gap).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within")
    )
    return table.select(
        F.lit(category).alias("category"),
        "feature",
        F.sqrt(F.try_divide(F.col("between"), F.col("between") + F.col("within"))).alias("eta"),
    )


def uncertainty_coefficient(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(x, y, u)``: share of the entropy of ``x`` explained by ``y`` (Theil's U)."""
    cells = df.dropna(subset=[x, y]).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))

    terms = F.sum(F.col("n") * F.log("n"))
    joint = cells.agg(terms.alias("xy"), F.sum("n").alias("total"))
    margins = [
        cells.groupBy(c).agg(F.sum("n").alias("n")).agg(terms).scalar() for c in (x, y)
    ]
    total = F.col("total").cast("double")
    h_x = F.log(total) - margins[0] / total
    # H(x|y) = H(x,y) - H(y)
    h_x_given_y = (margins[1] - F.col("xy")) / total
    return joint.select(
        F.lit(x).alias("x"),
        F.lit(y).alias("y"),
        F.coalesce(F.try_divide(h_x - h_x_given_y, h_x), F.lit(1.0)).alias("u"),
    )
