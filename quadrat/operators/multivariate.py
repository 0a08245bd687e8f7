"""Principal components: fit from one aggregate, apply as plain expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quadrat.functions.columns import number
from quadrat.functions.distributions import chi2_sf_column, t_ppf_column
from quadrat.operators.durable import durable
from quadrat.operators.linalg import fit_moments, linear
from quadrat.operators.quantiles import ranked_values
from quadrat.operators.sampling import cumulative_share, cut_at


@dataclass(frozen=True)
class Components:
    """Fitted principal components of the scaled (or only centred) columns."""

    columns: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    eigenvalues: np.ndarray  # sample variance of every component, largest first
    vectors: np.ndarray  # one row per kept component
    total: float

    @property
    def k(self) -> int:
        """Number of kept components."""
        return len(self.vectors)


def pca_fit(
    df: DataFrame, columns: Sequence[str], n_components: int | float, scale: bool = True
) -> Components:
    """Fit components; an integer is a count, a share keeps the fewest that exceed it.

    Columns are scaled to unit population deviation first. Each vector's largest
    loading is positive.
    """
    fit = fit_moments(df, columns)
    spread = np.sqrt(np.diag(fit.cov) * (fit.n - 1) / fit.n)
    spread = np.where(spread > 0, spread, 1.0) if scale else np.ones(len(columns))
    cov = fit.cov / np.outer(spread, spread)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1].clip(0), vectors[:, ::-1].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    vectors = vectors * np.where(signs == 0, 1, signs)[:, None]
    total = float(values.sum())
    if isinstance(n_components, float) and n_components < 1:
        shares = np.cumsum(values) / total
        k = int(np.searchsorted(shares, n_components, side="right")) + 1
        k = min(k, len(columns))
    else:
        k = int(n_components)
    return Components(tuple(columns), fit.mean, spread, values[:k], vectors[:k], total)


def pca_scores(df: DataFrame, model: Components) -> DataFrame:
    """Add ``pc1 … pck`` (centred scores)."""
    scores = {
        f"pc{i + 1}": linear(model.columns, model.vectors[i] / model.scale, model.centre)
        for i in range(model.k)
    }
    return df.withColumns(scores)


def pca_variance(spark: SparkSession, model: Components) -> DataFrame:
    """``(axis, pc, eigenvalue, percent, cumulated)`` per kept component."""
    rows = [
        (i + 1, f"pc{i + 1}", float(v), float(100 * v / model.total))
        for i, v in enumerate(model.eigenvalues)
    ]
    table = spark.createDataFrame(rows, "axis int, pc string, eigenvalue double, percent double")
    return cumulative_share(table, "axis", "percent")


def pca_loadings(spark: SparkSession, model: Components, squared: bool = True) -> DataFrame:
    """``(pc, feature, loading, strongest)``; squared loadings add up to one per axis."""
    rows = [
        (f"pc{i + 1}", c, float(w * w if squared else w))
        for i, vector in enumerate(model.vectors)
        for c, w in zip(model.columns, vector, strict=True)
    ]
    table = spark.createDataFrame(rows, "pc string, feature string, loading double")
    best = F.max_by("feature", F.abs("loading")).over(W.partitionBy("pc"))
    return table.withColumn("strongest", F.col("feature") == best)


def pca_analysis(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    n_components: int | float = 0.95,
    cutoff: float = 95.0,
) -> dict[str, DataFrame]:
    """Variance table, axes up to the cut-off, loadings, and scores on those axes."""
    spark = df.sparkSession
    model = pca_fit(df, columns, n_components)
    variance = pca_variance(spark, model)
    best = cut_at(variance, "axis", "cumulated", cutoff)
    shares = np.cumsum(100 * model.eigenvalues / model.total)
    axes = min(int(np.searchsorted(shares, cutoff)) + 1, model.k)
    scores = pca_scores(df, model).select(*keep, *[f"pc{i + 1}" for i in range(axes)])
    return {
        "variance": variance,
        "best_axes": best,
        "loadings": pca_loadings(spark, model),
        "scores": scores,
    }


def class_ellipses(
    df: DataFrame, x: str, y: str, target: str, confidence: float = 0.95
) -> DataFrame:
    """``(class, n, center_x, center_y, var_x, var_y, half_x, half_y)`` per class."""
    a, b = number(x), number(y)
    table = (
        df.filter(a.isNotNull() & b.isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(target).alias("class"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(a).alias("center_x"),
            F.avg(b).alias("center_y"),
            F.var_samp(a).alias("var_x"),
            F.var_samp(b).alias("var_y"),
        )
    )
    table = table.withColumn("__t", t_ppf_column((1 + confidence) / 2, F.col("n") - 1))
    return table.select(
        "*",
        (F.col("__t") * F.sqrt("var_x")).alias("half_x"),
        (F.col("__t") * F.sqrt("var_y")).alias("half_y"),
    ).drop("__t")


def hotelling_p(model: Components):
    """Fisher-combined chi-square p-value of the kept scores, as an expression."""
    statistic = F.lit(0.0)
    for i, value in enumerate(model.eigenvalues):
        ratio = F.pow(F.col(f"pc{i + 1}"), F.lit(2.0)) / F.lit(float(value))
        # -2 ln p, guarded where the tail underflows
        p = F.greatest(chi2_sf_column(ratio, 1), F.lit(1e-300))
        statistic = statistic - 2.0 * F.log(p)
    return chi2_sf_column(statistic, 2 * model.k)


def pca_outliers(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    min_variance: float = 0.95,
    alpha: float = 0.05,
    n_std: float = 2.0,
) -> DataFrame:
    """``(keep…, pc1…, p_value, ht2, spe, both)`` of complete rows.

    ``ht2`` holds where the Benjamini-Hochberg adjusted p-value is at most
    ``alpha``. The step-up rule equals one threshold on the raw p-value, found
    from counts of the p-values up to ``alpha`` only. ``spe`` holds outside the
    ``n_std`` ellipse of the first two components.
    """
    model = pca_fit(df, columns, min_variance)
    scored = pca_scores(df, model)
    pcs = [f"pc{i + 1}" for i in range(model.k)]
    scored = scored.select(*keep, *pcs).filter(F.col("pc1").isNotNull())
    scored = durable(scored.withColumn("p_value", hotelling_p(model)))
    threshold = bh_threshold(scored, "p_value", alpha)
    inside = F.pow(F.col("pc1"), F.lit(2.0)) / float(n_std**2 * model.eigenvalues[0])
    if model.k > 1:
        second = F.pow(F.col("pc2"), F.lit(2.0)) / float(n_std**2 * model.eigenvalues[1])
        inside = inside + second
    # components are uncorrelated, so the covariance frame of (pc1, pc2) is theirs
    flagged = scored.withColumn("ht2", F.col("p_value") <= F.lit(threshold)).withColumn(
        "spe", inside > 1.0
    )
    return flagged.withColumn("both", F.col("ht2") & F.col("spe"))


def bh_threshold(df: DataFrame, p: str, alpha: float) -> float:
    """Largest p with ``p * n / rank(p) <= alpha``; -1 if there is none.

    Only p-values up to ``alpha`` can qualify; they are counted and ranked by
    the distributed range sort.
    """
    n = df.count()
    ranks = ranked_values(df.filter(F.col(p) <= alpha), p)
    row = ranks.filter(F.col("value") * n <= alpha * F.col("last")).agg(F.max("value")).first()
    return -1.0 if row[0] is None else float(row[0])
