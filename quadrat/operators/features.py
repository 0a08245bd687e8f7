"""Scaling, imputing, encoding and selecting features.

Each operator first fits a few numbers per column with Spark aggregates and then
applies them in one projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.columns import is_missing, melt, number, require_columns
from quadrat.operators.durable import small_side
from quadrat.operators.profile import correlation_pairs, feature_value_counts, most_frequent
from quadrat.operators.quantiles import quantile_table
from quadrat.operators.table import label_map

MAX_CATEGORIES = 10_000  # categories become columns, so they must fit a schema


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def centre_and_scale(df: DataFrame, columns: Sequence[str], kind: str) -> Column:
    """Scalar map ``feature -> (centre, scale)`` for one kind of scaler.

    A scale of zero (constant column) is replaced by one.
    """
    if kind == "robust":
        quartiles = quantile_table(df, columns, [0.25, 0.5, 0.75])
        table = quartiles.select(
            "feature", F.col("q1").alias("centre"), (F.col("q2") - F.col("q0")).alias("scale")
        )
    else:
        def pair(c: str) -> tuple[Column, Column]:
            x = number(c)
            if kind == "standard":
                return F.avg(x), F.stddev_pop(x)
            if kind == "minmax":
                return F.min(x), F.max(x) - F.min(x)
            raise ValueError(f"unknown scaler {kind!r}")

        cells = [
            F.struct(
                F.lit(c).alias("feature"), pair(c)[0].alias("centre"), pair(c)[1].alias("scale")
            )
            for c in columns
        ]
        table = df.agg(F.array(*cells).alias("__c")).select(F.inline("__c"))
    scale = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")).alias("scale")
    entry = F.struct("feature", F.struct("centre", scale))
    return table.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def scale_columns(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """``(x - centre) / scale`` for every listed column."""
    require_columns(df, columns)
    fit = centre_and_scale(df, columns, kind)
    return _replace(
        df, {c: (number(c) - fit[c]["centre"]) / fit[c]["scale"] for c in columns}
    )


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation."""
    return scale_columns(df, columns, "standard")


def minmax_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]."""
    return scale_columns(df, columns, "minmax")


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the exact median and divide by the exact interquartile range."""
    return scale_columns(df, columns, "robust")


def yeo_johnson(x: Column, power: float | Column) -> Column:
    """Yeo-Johnson transform of one value."""
    power = power if isinstance(power, Column) else F.lit(float(power))
    up = F.when(F.abs(power) < 1e-12, F.log1p(x)).otherwise(
        F.try_divide(F.pow(x + 1, power) - 1, power)
    )
    rest = 2.0 - power
    down = F.when(F.abs(rest) < 1e-12, -F.log1p(-x)).otherwise(
        F.try_divide(1.0 - F.pow(1.0 - x, rest), rest)
    )
    return F.when(x >= 0, up).otherwise(down)


def fit_powers(
    df: DataFrame, columns: Sequence[str], low: float = -5.0, high: float = 5.0, points: int = 16
) -> dict[str, float]:
    """Maximum-likelihood Yeo-Johnson power per column.

    Every round evaluates ``points`` powers of all columns in one aggregate and
    narrows each column's interval around the best of them.
    """
    bounds = {c: (low, high) for c in columns}
    long = melt(df, columns).filter("value is not null")
    while max(b - a for a, b in bounds.values()) > 1e-6:
        grids = {
            c: [a + (b - a) * i / (points - 1) for i in range(points)]
            for c, (a, b) in bounds.items()
        }
        options = F.create_map(
            *[part for c in columns for part in (F.lit(c), F.lit(grids[c]))]
        )
        x = F.col("value")
        fits = (
            long.select("feature", "value", F.explode(options[F.col("feature")]).alias("power"))
            .groupBy("feature", "power")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.var_pop(yeo_johnson(x, F.col("power"))).alias("spread"),
                F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("jacobian"),
            )
            .collect()  # points rows per column
        )
        likelihood = {
            (r["feature"], r["power"]): -r["n"] / 2.0 * math.log(r["spread"])
            + (r["power"] - 1) * r["jacobian"]
            for r in fits
            if r["spread"] and math.isfinite(r["spread"])
        }
        for c in columns:
            values = [likelihood.get((c, g), -math.inf) for g in grids[c]]
            best = max(range(points), key=values.__getitem__)
            bounds[c] = (grids[c][max(0, best - 1)], grids[c][min(points - 1, best + 1)])
    return {c: (a + b) / 2 for c, (a, b) in bounds.items()}


def power_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Yeo-Johnson with fitted powers, then standardised."""
    powers = fit_powers(df, columns)
    return standardise(_replace(df, {c: yeo_johnson(number(c), powers[c]) for c in columns}), columns)


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill gaps with the exact median."""
    medians = quantile_table(df, columns, [0.5])
    fit = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "q0")))).scalar()
    return _replace(df, {c: F.coalesce(number(c), fit[c]) for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill gaps with the most frequent value; ties go to the smallest."""
    top = most_frequent(feature_value_counts(df, columns))
    fit = top.agg(F.map_from_entries(F.collect_list(F.struct("feature", "top")))).scalar()
    return _replace(
        df, {c: F.coalesce(F.col(c), fit[c].cast(df.schema[c].dataType)) for c in columns}
    )


def categories_of(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values; more than ``MAX_CATEGORIES`` is an error."""
    rows = (
        df.filter(F.col(column).isNotNull())
        .select(F.col(column).cast("string").alias("v"))
        .distinct()
        .limit(MAX_CATEGORIES + 1)
        .collect()
    )
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    return sorted(row["v"] for row in rows)


def one_hot(df: DataFrame, column: str, categories: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column ``column_value`` per sorted category; unseen values are all zero."""
    categories = list(categories or categories_of(df, column))
    text = F.col(column).cast("string")
    flags = [
        F.coalesce((text == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}")
        for v in categories
    ]
    return df.select(*[c for c in df.columns if c != column], *flags)


def ordinal_encode(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    """Replace a column by its sorted code; values not in ``codes`` become -1."""
    codes = label_map(df, column) if codes is None else codes
    table = small_side(
        codes.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
    )
    joined = df.join(table, F.col(column) == F.col("__label"), "left")
    return joined.select(
        *[F.coalesce("__code", F.lit(-1)).alias(c) if c == column else F.col(c) for c in df.columns]
    )


# Selection rules: each returns rows (feature, partner, value) of the columns to drop.


def sparse_features(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> list[tuple]:
    """Columns whose missing share exceeds the threshold."""
    n = F.count(F.lit(1))
    row = df.agg(
        *[F.try_divide(F.count_if(is_missing(df, c)), n).alias(c) for c in columns]
    ).first()
    return [(c, None, row[c]) for c in columns if row[c] is not None and row[c] > threshold]


def constant_features(df: DataFrame, columns: Sequence[str], tol: float = 0.95) -> list[tuple]:
    """Columns whose most frequent value covers at least ``tol`` of all rows.

    A value covering more than half of the rows stands at the median of any
    ordering, so an approximate median of the value hashes finds the only
    candidate; the second pass counts it. Nothing is shuffled but sketches.
    """
    if tol <= 0.5:
        counts = feature_value_counts(df, columns)
        total = df.agg(F.count(F.lit(1))).scalar()
        rows = most_frequent(counts).select("feature", (F.col("freq") / total).alias("share"))
        found = {r["feature"]: r["share"] for r in rows.collect()}
        return [(c, None, found[c]) for c in columns if found.get(c, 0.0) >= tol]

    def mark(c: str) -> Column:
        # 52 bits: the sketch works on doubles
        return F.when(F.col(c).isNotNull(), F.xxhash64(c).bitwiseAND(F.lit((1 << 52) - 1)))

    middle = df.agg(*[F.percentile_approx(mark(c), 0.5, 1000).alias(c) for c in columns]).first()
    n = F.count(F.lit(1))
    row = df.agg(
        *[F.try_divide(F.count_if(mark(c) == F.lit(middle[c])), n).alias(c) for c in columns]
    ).first()
    return [(c, None, row[c]) for c in columns if (row[c] or 0.0) >= tol]


def duplicate_features(df: DataFrame, columns: Sequence[str]) -> list[tuple]:
    """Columns with the same content as an earlier one.

    Order-free fingerprints of all columns come from one aggregate; only columns
    with equal fingerprints are compared row by row, in a second one.
    """

    def content(c: str) -> Column:
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        return number(c) if numeric else F.col(c).cast("string")

    def fingerprint(c: str) -> Column:
        h = F.xxhash64(content(c))
        return F.array(F.count(content(c)), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFF))))

    prints = df.agg(*[fingerprint(c).alias(c) for c in columns]).first()
    groups: dict[tuple, list[str]] = {}
    for c in columns:
        kind = isinstance(df.schema[c].dataType, T.NumericType)
        groups.setdefault((kind, *prints[c]), []).append(c)
    pairs = [(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[i + 1:]]
    if not pairs:
        return []
    differs = df.agg(
        *[
            F.count_if(~content(a).eqNullSafe(content(b))).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    ).first()
    found: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if differs[f"p{i}"] == 0 and a not in found:
            found.setdefault(b, a)
    return [(c, found[c], None) for c in columns if c in found]


def _correlations(df: DataFrame, columns: Sequence[str], method: str) -> dict[tuple, float]:
    if len(columns) < 2:
        return {}
    rows = correlation_pairs(df, columns, method).collect()  # one row per column pair
    return {(r["x"], r["y"]): r["r"] for r in rows if r["r"] is not None}


def correlated_features(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.8, method: str = "pearson"
) -> list[tuple]:
    """Greedy in column order: keep a column, drop the later ones it correlates with."""
    r = _correlations(df, columns, method)
    dropped: dict[str, tuple] = {}
    for i, a in enumerate(columns):
        if a in dropped:
            continue
        for b in columns[i + 1:]:
            if b not in dropped and abs(r.get((a, b), 0.0)) > threshold:
                dropped[b] = (b, a, r[a, b])
    return [dropped[c] for c in columns if c in dropped]


def correlated_to_drop(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.8
) -> DataFrame:
    """``(feature)`` rows: columns that correlate with any later column."""
    pairs = correlation_pairs(df, columns).filter(F.abs("r") > threshold)
    return pairs.select(F.col("x").alias("feature")).distinct()


def low_variance_features(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.0
) -> list[tuple]:
    """Numeric columns whose population variance is not above the threshold."""
    row = df.agg(*[F.var_pop(number(c)).alias(c) for c in columns]).first()
    return [(c, None, row[c]) for c in columns if (row[c] or 0.0) <= threshold]


def _without(df: DataFrame, dropped: list[tuple]) -> DataFrame:
    return df.drop(*[name for name, _, _ in dropped])


def drop_sparse_features(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Keep columns whose missing share is at most the threshold."""
    return _without(df, sparse_features(df, columns, threshold))


def drop_constant_features(df: DataFrame, columns: Sequence[str], tol: float = 0.95) -> DataFrame:
    """Drop nearly constant columns."""
    return _without(df, constant_features(df, columns, tol))


def drop_duplicate_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns that repeat an earlier one."""
    return _without(df, duplicate_features(df, columns))


def drop_correlated_features(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.8
) -> DataFrame:
    """Drop columns strongly correlated with an earlier kept one."""
    return _without(df, correlated_features(df, columns, threshold))


def drop_low_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Keep columns with a population variance above the threshold."""
    return _without(df, low_variance_features(df, columns, threshold))


def columns_missing_any(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that have at least one missing value."""
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def drop_sparse_rows(
    df: DataFrame, columns: Sequence[str], share: float | None = 0.03
) -> DataFrame:
    """Keep rows with at least ``share`` of their gap-prone columns filled.

    Only columns that have a gap somewhere count; ``None`` drops every row with
    a gap.
    """
    gappy = columns_missing_any(df, columns)
    if not gappy:
        return df
    if share is None:
        return df.na.drop(subset=gappy)
    return df.na.drop(thresh=math.ceil(share * len(gappy)), subset=gappy)
