"""Hypothesis tests: one data pass to a small table, then a little mathematics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quadrat.functions.columns import jarque_bera_value, melt, number
from quadrat.functions.distributions import (
    chi2_sf,
    f_sf,
    normal_ppf,
    normal_sf,
    studentized_range_ppf,
    studentized_range_sf_column,
)
from quadrat.operators.durable import small_side
from quadrat.operators.factorial import DENSE_COLUMNS, factor_cells, type_two_effects
from quadrat.operators.linalg import complete_rows
from quadrat.operators.quantiles import quantile_table, ranked_values, running_extreme


def group_table(df: DataFrame, y: str, group: str) -> DataFrame:
    """``(group, n, mean, var)`` of complete rows: all that the group tests need."""
    return (
        df.filter(number(y).isNotNull() & F.col(group).isNotNull())
        .groupBy(F.col(group).alias("group"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(number(y)).alias("mean"),
            F.coalesce(F.var_samp(number(y)), F.lit(0.0)).alias("var"),
        )
    )


def _sums_of_squares(groups: DataFrame) -> DataFrame:
    """One row ``(k, total, between, within)`` from a group table."""
    grand = groups.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    gap = F.col("mean") - grand
    return groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
    )


def anova_oneway(df: DataFrame, y: str, group: str) -> DataFrame:
    """Type I table: ``(source, df, sum_sq, mean_sq, f, p)`` for group and residual."""
    s = _sums_of_squares(group_table(df, y, group)).first()  # four numbers
    df1, df2 = s["k"] - 1, None if s["total"] is None else s["total"] - s["k"]

    def ratio(a: float | None, b: float | None) -> float | None:
        return a / b if a is not None and b else None

    mean_b, mean_w = ratio(s["between"], df1), ratio(s["within"], df2)
    f = ratio(mean_b, mean_w)
    p = f_sf(f, df1, df2) if f is not None else None
    lines = [(group, df1, s["between"], mean_b, f, p), ("Residual", df2, s["within"], mean_w, None, None)]
    return df.sparkSession.createDataFrame(
        lines, "source string, df bigint, sum_sq double, mean_sq double, f double, p double"
    )


def residuals(df: DataFrame, y: str, group: str, name: str = "residual") -> DataFrame:
    """Add ``y`` minus its group mean (a join to the group table, no window)."""
    means = group_table(df, y, group).select(
        F.col("group").alias("__group"), F.col("mean").alias("__mean")
    )
    joined = df.join(small_side(means), F.col(group) == F.col("__group"), "left")
    return joined.select(*df.columns, (number(y) - F.col("__mean")).alias(name))


def anova_unbalanced(
    df: DataFrame,
    y: str,
    factors: Sequence[str],
    effect_size: str = "n2",
    dense_columns: int = DENSE_COLUMNS,
) -> DataFrame:
    """Type II analysis of variance of any number of factors with all their interactions.

    ``(source, df, sum_sq, mean_sq, f, p, effect)``. One factor has a closed
    form in Spark sums. With more, the data pass ends in the table of
    factor-level cells, which stays in Spark at any size: models of up to
    ``dense_columns`` margin cells are solved from pair counts, larger ones by
    conjugate gradients over margin sums. An effect that empty cells leave
    without degrees of freedom has sum of squares 0 and no F.
    """
    if effect_size not in ("n2", "np2"):
        raise ValueError("effect_size must be n2 or np2")
    if not factors or len(set(factors)) < len(factors):
        raise ValueError("one or more different factors")
    if len(factors) == 1:
        s = _sums_of_squares(group_table(df, y, factors[0])).first()  # four numbers
        effects = [(factors[0], s["between"], s["k"] - 1)] if s["k"] else []
        return _effects_table(df, effects, s["within"], (s["total"] or 0) - s["k"], effect_size)
    cells = factor_cells(df, y, factors, dense_columns)
    if cells is None:
        return _effects_table(df, [], None, 0, effect_size)
    effects = type_two_effects(cells, factors)
    return _effects_table(df, effects, cells.within, cells.rows - cells.count, effect_size)


def _effects_table(
    df: DataFrame, effects: list[tuple], within: float | None, df_res: int, effect_size: str
) -> DataFrame:
    """The analysis-of-variance table of ``(source, sum of squares, df)`` effects; no rows without effects."""
    schema = "source string, df bigint, sum_sq double, mean_sq double, f double, p double, effect double"
    if not effects:
        return df.sparkSession.createDataFrame([], schema)
    total = sum(ss for _, ss, _ in effects) + within
    out = []
    for source, ss, dof in effects:
        f = (ss / dof) / (within / df_res) if dof and df_res and within else None
        whole = total if effect_size == "n2" else ss + within
        effect = ss / whole if whole else None
        out.append((source, dof, ss, ss / dof if dof else None, f,
                    f_sf(f, dof, df_res) if f is not None else None, effect))
    mean_sq = within / df_res if df_res else None
    out.append(("Residual", df_res, within, mean_sq, None, None, None))
    return df.sparkSession.createDataFrame(out, schema)


MANOVA_SCHEMA = "statistic string, value double, df1 double, df2 double, f double, p double"


def manova(df: DataFrame, responses: Sequence[str], group: str) -> DataFrame:
    """Wilks, Pillai, Hotelling-Lawley and Roy for one factor, with F approximations.

    Hypothesis and error matrices are p x p sums taken by Spark; the F forms are
    the standard ones in s, m and n.
    """
    p = len(responses)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    rows = df.filter(complete_rows(df, responses) & F.col(group).isNotNull())
    groups = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(responses)],
        *[
            F.covar_pop(number(responses[i]), number(responses[j])).alias(f"c{i}_{j}")
            for i, j in upper
        ],
    )
    grand = groups.agg(
        F.struct(*[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(p)])
    ).scalar()
    row = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        *[
            F.sum(
                F.col("n") * (F.col(f"m{i}") - grand[f"m{i}"]) * (F.col(f"m{j}") - grand[f"m{j}"])
            ).alias(f"h{i}_{j}")
            for i, j in upper
        ],
        *[F.sum(F.col("n") * F.col(f"c{i}_{j}")).alias(f"e{i}_{j}") for i, j in upper],
    ).first()
    if row["k"] < 2 or row["total"] <= row["k"]:  # nothing to compare
        return df.sparkSession.createDataFrame([], MANOVA_SCHEMA)
    h, e = np.zeros((p, p)), np.zeros((p, p))
    for i, j in upper:
        h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        e[i, j] = e[j, i] = row[f"e{i}_{j}"]
    lines = multivariate_statistics(h, e, row["k"] - 1, row["total"] - row["k"])
    return df.sparkSession.createDataFrame(lines, MANOVA_SCHEMA)


def multivariate_statistics(h: np.ndarray, e: np.ndarray, q: int, v: int) -> list[tuple]:
    """``(statistic, value, df1, df2, f, p)`` of a hypothesis matrix with ``q`` and an error matrix with ``v`` degrees of freedom."""
    p = len(h)
    roots = np.clip(np.linalg.eigvals(np.linalg.solve(e, h)).real, 0, None)
    s, m, n = min(p, q), (abs(p - q) - 1) / 2, (v - p - 1) / 2
    roots = np.sort(roots)[::-1][:s]
    wilks = float(np.prod(1 / (1 + roots)))
    pillai, hotelling, roy = float((roots / (1 + roots)).sum()), float(roots.sum()), float(roots[0])
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    w2 = t * (v + q - (p + q + 1) / 2) - (p * q - 2) / 2
    a = 2 * m + s + 1
    r = max(p, q)
    lines = [
        ("Wilks' lambda", wilks, p * q, w2, (wilks ** (-1 / t) - 1) * w2 / (p * q)),
        ("Pillai's trace", pillai, s * a, s * (2 * n + s + 1), (2 * n + s + 1) / a * pillai / (s - pillai)),
        ("Hotelling-Lawley trace", hotelling, s * a, 2 * (s * n + 1), 2 * (s * n + 1) * hotelling / (s * s * a)),
        ("Roy's greatest root", roy, r, v - r + q, roy * (v - r + q) / r),
    ]
    return [
        (name, float(value), float(d1), float(d2), float(f), f_sf(f, d1, d2))
        for name, value, d1, d2, f in lines
    ]


def _group_pairs(groups: DataFrame) -> DataFrame:
    """Every pair of groups, with the pooled error.

    Groups are numbered; each names its later partners, and an equi-join brings
    those in. The result has one row per comparison by definition.
    """
    error = _sums_of_squares(groups).agg(
        F.first(
            F.struct(
                "k",
                (F.col("total") - F.col("k")).alias("df"),
                F.try_divide(F.col("within"), F.col("total") - F.col("k")).alias("mse"),
            )
        )
    ).scalar()
    numbered = groups.select(
        F.row_number().over(W.orderBy("group")).alias("i"), "group", "n", "mean"
    )
    left = numbered.select(
        F.col("group").alias("a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"), "i",
        error.alias("e"),
    ).filter(F.col("i") < F.col("e.k"))
    left = left.select(
        "a", "n_a", "mean_a", F.col("e.k").alias("k"), F.col("e.df").alias("df"),
        F.col("e.mse").alias("mse"),
        F.explode(F.sequence(F.col("i") + 1, F.col("e.k").cast("int"))).alias("i"),
    )
    right = numbered.select(
        F.col("group").alias("b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"), "i"
    )
    return left.join(right, "i").drop("i")


def tukey_hsd(df: DataFrame, y: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Tukey-Kramer: ``(a, b, diff, se, p_adj, low, high, reject)`` for all group pairs.

    ``diff`` is mean(b) - mean(a) and ``se`` the studentised-range standard error
    sqrt(mse / 2 * (1/n_a + 1/n_b)).
    """
    pairs = _group_pairs(group_table(df, y, group))
    se = F.sqrt(F.col("mse") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    pairs = pairs.withColumn("diff", F.col("mean_b") - F.col("mean_a")).withColumn("se", se)
    shape = pairs.agg(F.first("k"), F.first("df")).first()  # two numbers
    critical = (
        studentized_range_ppf(1 - alpha, int(shape[0]), float(shape[1])) if shape[0] else math.nan
    )
    q = F.try_divide(F.abs("diff"), F.col("se"))
    return pairs.withColumn("p_adj", studentized_range_sf_column(q, F.col("k"), F.col("df"))).select(
        "a", "b", "diff", "se", "p_adj",
        (F.col("diff") - critical * F.col("se")).alias("low"),
        (F.col("diff") + critical * F.col("se")).alias("high"),
        (F.col("p_adj") < alpha).alias("reject"),
    )


def pairwise_tukey(df: DataFrame, y: str, group: str) -> DataFrame:
    """``(a, b, mean_a, mean_b, diff, se, t, p_tukey, hedges)`` for all group pairs.

    ``se`` is sqrt(mse * (1/n_a + 1/n_b)) and ``diff`` mean(a) - mean(b).
    """
    groups = group_table(df, y, group)
    pairs = _group_pairs(groups)
    for side in ("a", "b"):
        variance = groups.select(F.col("group").alias(side), F.col("var").alias(f"var_{side}"))
        pairs = pairs.join(variance, side)
    se = F.sqrt(F.col("mse") * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = F.sqrt(
        F.try_divide(
            (F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), dof
        )
    )
    shrink = 1.0 - 3.0 / (4.0 * (F.col("n_a") + F.col("n_b")) - 9.0)
    pairs = (
        pairs.withColumn("diff", F.col("mean_a") - F.col("mean_b"))
        .withColumn("se", se)
        .withColumn("t", F.try_divide(F.col("diff"), F.col("se")))
    )
    p = studentized_range_sf_column(F.abs("t") * math.sqrt(2.0), F.col("k"), F.col("df"))
    return pairs.withColumn("p_tukey", p).select(
        "a", "b", "mean_a", "mean_b", "diff", "se", "t", "p_tukey",
        (F.try_divide(F.col("diff"), pooled) * shrink).alias("hedges"),
    )


def adjust_pvalues(
    df: DataFrame,
    p: str,
    method: str = "bonferroni",
    alpha: float = 0.05,
    family: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add ``corrected`` and ``reject``; families given by key columns are independent.

    A family may be of any size. Equal p-values get one correction (so ``ties``
    has no influence), hence the ordered methods rank the distinct values by a
    range sort, carry running extremes from slot to slot and join the result to
    the rows. Rows without a p-value are in no count and get NULL.
    """
    if method not in ("bonferroni", "sidak", "holm", "fdr_bh", "fdr_by"):
        raise ValueError(f"unknown method {method!r}")
    keys = ["__family"] if family else []  # one text, never null: rows without a key are a family as well
    own = F.to_json(F.struct(*family)) if family else None
    named = df.select(*[own.alias(k) for k in keys], number(p).alias("__p")).where("__p IS NOT NULL")
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("__m"))
    same = [own == F.col(k) for k in keys]
    if method in ("bonferroni", "sidak"):
        x, m = number(p), F.col("__m")
        value = x * m if method == "bonferroni" else -F.expm1(m * F.log1p(-x))
        rows = df.join(small_side(counts), reduce(and_, same), "left") if family else df.withColumn("__m", counts.select("__m").scalar())
        return _rejected(rows, value, alpha).drop("__m", *keys)
    ranked = ranked_values(named, "__p", keys)
    if family:
        ranked = ranked.join(counts, keys)
    else:
        ranked = ranked.withColumn("__m", counts.select("__m").scalar())
    x, m = F.col("value"), F.col("__m")
    if method == "holm":  # the first of equal values has the largest product, the last the smallest ratio
        table = running_extreme(ranked.withColumn("__raw", x * (m - F.col("first") + 1)), "value", "__raw", "max", keys)
    else:
        raw = x * m / F.col("last") * (_harmonic(m) if method == "fdr_by" else F.lit(1.0))
        table = running_extreme(ranked.withColumn("__raw", raw), "value", "__raw", "min", keys)
    table = small_side(table.select(*keys, F.col("value").alias("__value"), "extreme"))
    rows = df.join(table, reduce(and_, [*same, number(p) == F.col("__value")]), "left")
    return _rejected(rows, F.col("extreme"), alpha).drop("extreme", "__value", *keys)


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + … + 1/m: added up to 32, beyond by the asymptotic series (exact to 1e-14)."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(32.0)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    euler = 0.5772156649015329
    many = F.log(m) + euler + 1.0 / (2.0 * m) - 1.0 / (12.0 * m * m) + 1.0 / (120.0 * m * m * m * m)
    return F.when(m <= 32, few).otherwise(many)


def _rejected(df: DataFrame, corrected: Column, alpha: float) -> DataFrame:
    limited = F.when(corrected.isNotNull(), F.least(corrected, F.lit(1.0)))
    return df.withColumn("corrected", limited).withColumn(
        "reject", F.col("corrected") <= alpha
    )


def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    """``(n, statistic, p)`` from biased moments."""
    x = number(column)
    table = df.agg(
        F.count(x).alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2")
    ).withColumn("statistic", jarque_bera_value(F.col("n"), F.col("g1"), F.col("g2")))
    return table.select("n", "statistic", F.exp(-F.col("statistic") / 2.0).alias("p"))


def dagostino(df: DataFrame, column: str) -> DataFrame:
    """D'Agostino-Pearson K-squared ``(n, statistic, p)`` from biased moments."""
    x = number(column)
    table = df.agg(
        F.count(x).cast("double").alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2")
    )
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    table = table.select(
        "n",
        (g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))).alias("y"),
        (
            3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
            / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        ).alias("beta"),
        (
            (g2 + 3 - 3.0 * (n - 1) / (n + 1))
            / F.sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
        ).alias("x"),
        (
            6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
            * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        ).alias("s"),
    )
    s = F.col("s")
    table = table.withColumn("w2", F.sqrt(2.0 * (F.col("beta") - 1)) - 1).withColumn(
        "a", 6.0 + 8.0 / s * (2.0 / s + F.sqrt(1.0 + 4.0 / (s * s)))
    )
    a = F.col("a")
    z1 = F.asinh(F.col("y") / F.sqrt(2.0 / (F.col("w2") - 1))) / F.sqrt(0.5 * F.log("w2"))
    tail = (1.0 - 2.0 / a) / (1.0 + F.col("x") * F.sqrt(2.0 / (a - 4.0)))
    z2 = (1.0 - 2.0 / (9.0 * a) - F.cbrt(tail)) / F.sqrt(2.0 / (9.0 * a))
    return table.withColumn("statistic", z1 * z1 + z2 * z2).select(
        F.col("n").cast("bigint").alias("n"),
        "statistic",
        F.exp(-F.col("statistic") / 2.0).alias("p"),
    )


# fixed values: polynomial coefficients of Royston (1995), highest power first
ROYSTON_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
ROYSTON_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
ROYSTON_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
ROYSTON_LOG_SD = (0.0030302, -0.082676, -0.4803)
ROYSTON_SMALL_MEAN = (-0.0006714, 0.025054, -0.39978, 0.5440)
ROYSTON_SMALL_LOG_SD = (-0.0020322, 0.062767, -0.77857, 1.3822)

SCORE_CHUNK = 100_000


def _normal_scores(batches):
    """Sums of the normal scores and their squares over each run of positions."""
    import pandas as pd

    quantile = np.vectorize(normal_ppf, otypes=[float])
    for batch in batches:
        sums, squares = [], []
        for start, end, n in zip(batch["start"], batch["end"], batch["total"], strict=True):
            m = quantile((np.arange(start, end + 1, dtype=float) - 0.375) / (n + 0.25))
            sums.append(m.sum())
            squares.append((m * m).sum())
        yield pd.DataFrame(
            {"feature": batch["feature"], "centred": batch["centred"], "m": sums, "m2": squares}
        )


def shapiro_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shapiro-Wilk ``(feature, n, statistic, p)`` of several columns with Royston's weights.

    Ranks come from one distributed range sort. Weights need only the rank, so
    W is a ratio of aggregates over the distinct values; the positions of a
    frequent value are cut into chunks that spread over the tasks. The p-value
    approximation is published for n up to 5000; W uses every row for any n.
    """
    long = melt(df, columns).filter("value is not null")
    ranks = ranked_values(long, "value", ["feature"])
    whole = ranks.groupBy("feature").agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
    )
    ranks = ranks.join(small_side(whole), "feature").withColumn(
        "centred", F.col("value") - F.col("mean")
    )

    def at(position: Column) -> Column:
        return F.max(
            F.when((F.col("first") <= position) & (F.col("last") >= position), F.col("centred"))
        )

    chunks = ranks.select(
        "feature", "centred", "last", "total",
        F.explode(F.sequence("first", "last", F.lit(SCORE_CHUNK))).alias("start"),
    ).withColumn("end", F.least(F.col("start") + SCORE_CHUNK - 1, F.col("last")))
    scored = (
        chunks.select("feature", "centred", "total", "start", "end")
        .repartition("feature", "start")
        .mapInPandas(_normal_scores, "feature string, centred double, m double, m2 double")
    )
    sums = scored.groupBy("feature").agg(
        F.sum(F.col("m") * F.col("centred")).alias("mx"), F.sum("m2").alias("mm")
    )
    n = F.col("total")
    ends = ranks.groupBy("feature", "total").agg(
        F.sum(F.col("n") * F.col("centred") * F.col("centred")).alias("ss"),
        *[at(k).alias(c) for k, c in ((F.lit(1), "x1"), (F.lit(2), "x2"), (n - 1, "y2"), (n, "y1"))],
    )
    rows = []
    for r in sums.join(ends, "feature").collect():  # one row per column
        if r["total"] < 3:
            rows.append((r["feature"], r["total"], None, None))
        elif not r["ss"]:
            rows.append((r["feature"], r["total"], 1.0, 1.0))
        else:
            w = min(1.0, _royston_w(r["total"], r["mx"], r["mm"], r))
            rows.append((r["feature"], r["total"], float(w), _royston_p(r["total"], w)))
    return df.sparkSession.createDataFrame(
        rows, "feature string, n bigint, statistic double, p double"
    )


def shapiro_wilk(df: DataFrame, column: str) -> DataFrame:
    """``(n, statistic, p)`` of one column."""
    return shapiro_table(df, [column]).drop("feature")


def feature_rank_shapiro(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(rank, feature, statistic)``: columns by their Shapiro-Wilk W, largest first."""
    order = W.orderBy(F.col("statistic").desc(), "feature")  # one row per column
    return shapiro_table(df, columns).select(
        F.row_number().over(order).alias("rank"), "feature", "statistic"
    )


def _royston_w(n: int, mx: float, mm: float, ends) -> float:
    outer, inner = ends["y1"] - ends["x1"], ends["y2"] - ends["x2"]
    if n == 3:
        return (math.sqrt(0.5) * outer) ** 2 / ends["ss"]
    m_last, m_second = normal_ppf((n - 0.375) / (n + 0.25)), normal_ppf((n - 1.375) / (n + 0.25))
    u = 1 / math.sqrt(n)
    a_last = float(np.polyval(ROYSTON_LAST, u)) + m_last / math.sqrt(mm)
    if n <= 5:
        phi = (mm - 2 * m_last**2) / (1 - 2 * a_last**2)
        total = (mx - m_last * outer) / math.sqrt(phi) + a_last * outer
        return total**2 / ends["ss"]
    a_second = float(np.polyval(ROYSTON_SECOND, u)) + m_second / math.sqrt(mm)
    phi = (mm - 2 * m_last**2 - 2 * m_second**2) / (1 - 2 * a_last**2 - 2 * a_second**2)
    total = (mx - m_last * outer - m_second * inner) / math.sqrt(phi)
    return (total + a_last * outer + a_second * inner) ** 2 / ends["ss"]


def _royston_p(n: int, w: float) -> float:
    if w >= 1:
        return 1.0
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    z = math.log(1 - w)
    if n <= 11:
        top = 0.459 * n - 2.273 - z
        if top <= 0:
            return 0.0
        z, at = -math.log(top), n
        mean, log_sd = ROYSTON_SMALL_MEAN, ROYSTON_SMALL_LOG_SD
    else:
        mean, log_sd, at = ROYSTON_MEAN, ROYSTON_LOG_SD, math.log(n)
    return float(normal_sf((z - np.polyval(mean, at)) / math.exp(np.polyval(log_sd, at))))


def normality_tests(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """``(test, n, statistic, p, normal)`` for Shapiro-Wilk, K-squared and Jarque-Bera."""
    tests = {
        "Shapiro-Wilk": shapiro_wilk, "D'Agostino-Pearson": dagostino, "Jarque-Bera": jarque_bera,
    }
    table = None
    for name, test in tests.items():
        row = test(df, column).select(F.lit(name).alias("test"), "n", "statistic", "p")
        table = row if table is None else table.unionAll(row)
    return table.withColumn("normal", F.col("p") > 1 - confidence)


def equal_variance_tests(
    df: DataFrame, y: str, group: str, confidence: float = 0.95
) -> DataFrame:
    """``(test, statistic, p, equal_var)`` for Bartlett and median-centred Levene."""
    rows = df.filter(number(y).isNotNull() & F.col(group).isNotNull())
    groups = group_table(rows, y, group).filter("n > 1")
    b = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
        F.sum((F.col("n") - 1) * F.log("var")).alias("logs"),
        F.count_if(F.col("var") <= 0).alias("flat"),
        F.sum(1.0 / (F.col("n") - 1)).alias("inverse"),
    ).first()
    schema = "test string, statistic double, p double, equal_var boolean"
    if b["k"] < 2:  # nothing to compare
        nothing = [(name, None, None, None) for name in ("Bartlett", "Levene")]
        return df.sparkSession.createDataFrame(nothing, schema)
    dof = b["total"] - b["k"]
    if b["flat"]:  # a group without variance: infinitely unequal, unless all are flat
        bartlett = None if b["flat"] == b["k"] else math.inf
    else:
        top = dof * math.log(b["within"] / dof) - b["logs"]
        bartlett = top / (1 + (b["inverse"] - 1 / dof) / (3 * (b["k"] - 1)))
    text = rows.withColumn("__g", F.col(group).cast("string"))
    medians = quantile_table(text, [y], [0.5], ["__g"]).select("__g", F.col("q0").alias("__m"))
    spread = text.join(small_side(medians), "__g").select(
        "__g", F.abs(number(y) - F.col("__m")).alias("__spread")
    )
    s = _sums_of_squares(group_table(spread, "__spread", "__g")).first()
    df1, df2 = s["k"] - 1, s["total"] - s["k"]
    levene = (s["between"] / df1) / (s["within"] / df2) if s["within"] and df2 > 0 else None

    def line(name: str, value: float | None, tail) -> tuple:
        if value is None:
            return name, None, None, None
        p = 0.0 if math.isinf(value) else tail(value)
        return name, float(value), p, p > 1 - confidence

    lines = [
        line("Bartlett", bartlett, lambda v: chi2_sf(v, b["k"] - 1)),
        line("Levene", levene, lambda v: f_sf(v, df1, df2)),
    ]
    return df.sparkSession.createDataFrame(lines, schema)


def tukey_intervals(df: DataFrame, y: str, group: str, alpha: float = 0.05) -> DataFrame:
    """``(group, n, mean, low, high)``: intervals whose overlap means no difference.

    Half-widths for unequal sizes follow Hochberg and Tamhane: they are built
    from each group's sum of pairwise standard errors.
    """
    groups = group_table(df, y, group)
    gap = F.sqrt(F.col("mse") / F.col("n_a") + F.col("mse") / F.col("n_b"))
    pairs = _group_pairs(groups).withColumn("gap", gap)
    head = pairs.agg(F.first("k"), F.first("df"), F.sum("gap")).first()  # three numbers
    k, whole = head[0], head[2]
    if not k:
        raise ValueError("at least two groups are needed")
    sides = F.inline(
        F.array(*[F.struct(F.col(side).alias("group"), "gap") for side in ("a", "b")])
    )
    own = pairs.select(sides).groupBy("group").agg(F.sum("gap").alias("own"))
    width = (
        F.col("own") / 2.0
        if k == 2
        else (F.col("own") * (k - 1.0) - whole) / float((k - 1) * (k - 2))
    )
    half = width * (studentized_range_ppf(1 - alpha, k, float(head[1])) / math.sqrt(2.0))
    return groups.join(own, "group").select(
        "group", "n", "mean",
        (F.col("mean") - half).alias("low"),
        (F.col("mean") + half).alias("high"),
    )
