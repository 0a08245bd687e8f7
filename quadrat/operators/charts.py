"""The tables behind the usual statistical charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import adjusted_skewness, melt, number
from quadrat.functions.distributions import normal_ppf, normal_ppf_column, t_ppf_column
from quadrat.operators.durable import small_side
from quadrat.operators.quantiles import quantile_table, ranked_values
from quadrat.operators.sampling import hashed_rank


def histogram(
    df: DataFrame,
    column: str,
    bins: int = 20,
    binwidth: float | None = None,
    hue: str | None = None,
) -> DataFrame:
    """``(hue?, bin, bin_lo, bin_hi, n)`` over equal bins from the minimum."""
    x = number(column)
    limits = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    if binwidth:
        width, last = F.lit(float(binwidth)), None
    else:
        span = (limits["hi"] - limits["lo"]) / float(bins)
        width, last = F.when(span > 0, span).otherwise(1.0), bins - 1
    index = F.floor((x - limits["lo"]) / width)
    index = index if last is None else F.least(index, F.lit(last))
    keys = [hue] if hue else []
    counts = (
        df.filter(x.isNotNull()).groupBy(*keys, index.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    low = limits["lo"] + F.col("bin") * width
    return counts.select(*keys, "bin", low.alias("bin_lo"), (low + width).alias("bin_hi"), "n")


def kde(
    df: DataFrame, column: str, hue: str | None = None, grid: int = 200, bins: int = 1000
) -> DataFrame:
    """``(hue, x, density, skew)``: Gaussian kernel density with Scott's bandwidth.

    Rows are first folded to at most ``bins`` weighted points per group, so the
    kernel sums do not grow with the data.
    """
    x = number(column)
    rows = df.select(
        (F.col(hue).cast("string") if hue else F.lit("all")).alias("hue"), x.alias("v")
    ).dropna()
    shape = rows.groupBy("hue").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("v").alias("s"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.skewness("v").alias("g1"),
    )
    shape = shape.filter("n > 1 and s > 0").select(
        "hue", "n", "lo", "hi",
        (F.col("s") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"),
        adjusted_skewness(F.col("n"), F.col("g1")).alias("skew"),
    )
    shape = small_side(shape)
    step = (F.col("hi") - F.col("lo")) / float(bins - 1)
    points = (
        rows.join(shape, "hue")
        .groupBy("hue", F.round((F.col("v") - F.col("lo")) / step).alias("i"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    reach = 3.0 * F.col("h")
    at = (F.col("lo") - reach) + F.col("g") * (
        (F.col("hi") - F.col("lo") + 2.0 * reach) / float(grid - 1)
    )
    centred = (F.col("x") - (F.col("lo") + F.col("i") * step)) / F.col("h")
    kernel = F.exp(-0.5 * centred * centred) / float(np.sqrt(2 * np.pi))
    return (
        points.join(shape, "hue")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
        .withColumn("x", at)
        .groupBy("hue", "g", "x", "skew")
        .agg(F.sum(F.col("w") * kernel / (F.col("n") * F.col("h"))).alias("density"))
        .select("hue", "x", "density", "skew")
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and flier count per group."""
    quartiles = quantile_table(df, [column], [0.25, 0.5, 0.75], by).select(
        *by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    rows = melt(df.dropna(subset=list(by)) if by else df, [column], by).filter("value is not null")
    if by:
        joined = rows.join(small_side(quartiles), list(by))
    else:
        fit = quartiles.agg(F.first(F.struct("q1", "median", "q3"))).scalar()
        joined = rows.select("value", fit.alias("__q")).select("value", "__q.*")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


def mean_intervals(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], confidence: float = 0.95
) -> DataFrame:
    """``(by…, feature, n, mean, low, high)`` with the t interval."""
    long = melt(df.dropna(subset=list(by)), columns, by).filter("value is not null")
    table = long.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("s"),
    )
    half = t_ppf_column((1 + confidence) / 2, F.col("n") - 1) * F.col("s") / F.sqrt("n")
    return table.withColumn("__h", half).select(
        *by, "feature", "n", "mean",
        (F.col("mean") - F.col("__h")).alias("low"),
        (F.col("mean") + F.col("__h")).alias("high"),
    )


def bar_means(
    df: DataFrame,
    category: str,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    hue: str | None = None,
    replicates: int = 200,
    seed: int = 42,
) -> DataFrame:
    """``(category, hue?, feature, mean, low, high)`` with a bootstrap 95 % interval.

    Every row gets a Poisson(1) weight per replicate, drawn from a hash of its
    keys, so that the resampling is one aggregate and the same on every run.
    Without ``keys`` the t interval is given instead.
    """
    by = [category, *([hue] if hue else [])]
    if not keys:
        return mean_intervals(df, by, columns).drop("n")
    ident = F.xxhash64(*keys, F.lit(seed))
    rows = df.dropna(subset=by).withColumn("__id", ident)
    long = melt(rows, columns, [*by, "__id"]).filter("value is not null")
    means = long.groupBy(*by, "feature").agg(F.avg("value").alias("mean"))
    # fixed values: cumulative Poisson(1) probabilities
    cumulative = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153,
                  0.999405815, 0.999916759, 0.999989751)
    drawn = F.pmod(F.xxhash64("__id", "replicate"), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(F.col("__u") > c, 1).otherwise(0) for c in cumulative), F.lit(0))
    resampled = (
        long.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("__u", drawn)
        .withColumn("__w", weight)
        .groupBy(*by, "feature", "replicate")
        .agg(F.try_divide(F.sum(F.col("__w") * F.col("value")), F.sum("__w")).alias("m"))
        .groupBy(*by, "feature")  # one value per replicate
        .agg(F.expr("percentile(m, array(0.025, 0.975))").alias("q"))
    )
    return means.join(resampled, [*by, "feature"]).select(
        *by, "feature", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")
    )


def line_means(df: DataFrame, x: str, y: str, confidence: float = 0.95) -> DataFrame:
    """``(x, n, mean, low, high)`` of y for every x."""
    return mean_intervals(df, [x], [y], confidence).drop("feature")


def pair_regressions(df: DataFrame, columns: Sequence[str], hue: str | None = None) -> DataFrame:
    """``(hue?, x, y, slope, intercept, r2, n)`` for each column pair, one aggregate."""
    cells = [
        F.struct(
            F.lit(a).alias("x"),
            F.lit(b).alias("y"),
            F.regr_slope(number(b), number(a)).alias("slope"),
            F.regr_intercept(number(b), number(a)).alias("intercept"),
            F.regr_r2(number(b), number(a)).alias("r2"),
            F.regr_count(number(b), number(a)).alias("n"),
        )
        for a, b in combinations(columns, 2)
    ]
    keys = [hue] if hue else []
    return df.groupBy(*keys).agg(F.array(*cells).alias("__c")).select(*keys, F.inline("__c"))


def qq_points(
    df: DataFrame, column: str, confidence: float = 0.95, points: int | None = None
) -> DataFrame:
    """``(rank, theoretical, sample, low, high)`` of the standardised sample.

    Positions are (i - 0.5) / n; the envelope comes from the order-statistic
    standard error. With ``points`` the chart is thinned to that many evenly
    spaced exact quantiles.
    """
    x = number(column)
    stats = df.agg(
        F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n"))
    ).scalar()
    if points:
        probs = [(i + 0.5) / points for i in range(points)]
        cells = F.array(
            *[
                F.struct(F.lit(i + 1.0).alias("rank"), F.lit(p).alias("p"),
                         F.col(f"q{i}").alias("value"))
                for i, p in enumerate(probs)
            ]
        )
        placed = quantile_table(df, [column], probs).select(F.inline(cells))
    else:
        placed = ranked_values(df, column).select(
            F.col("rank"), ((F.col("rank") - 0.5) / stats["n"]).alias("p"), "value"
        )
    placed = placed.withColumn("theoretical", normal_ppf_column(F.col("p"))).withColumn(
        "sample", F.try_divide(F.col("value") - stats["m"], stats["s"])
    )
    z = F.col("theoretical")
    density = F.exp(-z * z / 2.0) / float(np.sqrt(2 * np.pi))
    error = F.sqrt(F.col("p") * (1.0 - F.col("p")) / stats["n"]) / density
    reach = normal_ppf((1 + confidence) / 2) * error
    return placed.select(
        "rank", "theoretical", "sample", (z - reach).alias("low"), (z + reach).alias("high")
    )


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50, hue: str | None = None) -> DataFrame:
    """``(hue?, bin_x, bin_y, n)``: all rows of a scatter plot as a density grid."""
    a, b = number(x), number(y)
    limits = df.agg(
        F.struct(
            F.min(a).alias("ax"), F.max(a).alias("bx"), F.min(b).alias("ay"), F.max(b).alias("by")
        )
    ).scalar()

    def place(value: Column, low: Column, high: Column) -> Column:
        share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
        return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")

    keys = [hue] if hue else []
    rows = df.filter(a.isNotNull() & b.isNotNull())
    return rows.groupBy(
        *keys,
        place(a, limits["ax"], limits["bx"]).alias("bin_x"),
        place(b, limits["ay"], limits["by"]).alias("bin_y"),
    ).agg(F.count(F.lit(1)).alias("n"))


def scatter_sample(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    n: int = 1000,
    by: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """At most ``n`` reproducible points (per ``by`` value) for a scatter plot."""
    ranked = hashed_rank(df, keys, seed, by=[by] if by else [], name="__rank")
    kept = [*keys, *columns, *([by] if by else [])]
    return ranked.filter(F.col("__rank") <= n).select(*dict.fromkeys(kept))


def scatter_pairs(df: DataFrame, pcs: Sequence[str], percents: Sequence[float], bins: int = 50) -> DataFrame:
    """``(x, y, bin_x, bin_y, n)`` for every component pair, axes labelled with their share."""
    labels = {c: f"{c.upper()} ({p:.1f} %)" for c, p in zip(pcs, percents, strict=True)}
    table = None
    for a, b in combinations(pcs, 2):
        part = scatter_bins(df, a, b, bins).select(
            F.lit(labels[a]).alias("x"), F.lit(labels[b]).alias("y"), "bin_x", "bin_y", "n"
        )
        table = part if table is None else table.unionAll(part)
    return table


def decision_grid(
    df: DataFrame, x: str, y: str, model: Model, size: int = 200, margin: float = 1.0
) -> DataFrame:
    """``(x, y, prediction)`` on a size x size grid over the range of two features."""
    ax, bx, ay, by = df.agg(
        F.min(number(x)), F.max(number(x)), F.min(number(y)), F.max(number(y))
    ).first()
    cell = df.sparkSession.range(size * size)

    def axis(index: Column, low: float, high: float) -> Column:
        low, high = low - margin, high + margin
        return F.lit(low) + index * ((high - low) / (size - 1))

    grid = cell.select(
        axis(F.floor(F.col("id") / size), ax, bx).alias(x),
        axis(F.col("id") % size, ay, by).alias(y),
    )
    ready = VectorAssembler(inputCols=[x, y], outputCol="features").transform(grid)
    return model.transform(ready).select(x, y, "prediction")
