"""Outliers, components and hypothesis tests against numpy and hand-worked values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.functions import distributions as d
from quadrat.operators import charts, hypotheses, multivariate, outliers, profile, table
from quadrat.plans import reports


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    x[5] += 30
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(key=range(200), g=np.arange(200) % 4)
    pdf["g"] = pdf["g"].map(lambda v: f"g{v}")
    return spark.createDataFrame(pdf), pdf



def test_equal_variances_of_odd_groups(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 5.0), ("b", 9.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    bartlett = hypotheses.equal_variance_tests(df, "y", "g").first()
    assert bartlett["p"] == 0 and not bartlett["equal_var"]
    for few in (df.limit(0), df.where("g = 'a'")):
        assert all(r["statistic"] is None for r in hypotheses.equal_variance_tests(few, "y", "g").collect())
    assert hypotheses.anova_unbalanced(df.limit(0), "y", ["g"]).count() == 0
    twice = df.withColumn("z", F.col("y") * F.col("y"))
    assert hypotheses.manova(twice.limit(0), ["y", "z"], "g").count() == 0
    assert hypotheses.manova(twice.where("g = 'b'"), ["y", "z"], "g").count() == 0


def test_constant_and_tied_columns(spark):
    rows = [(i, 7.0, 1.0 if i < 9 else 5.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, c double, t double")
    assert outliers.zscore_outliers(df, "c", "k").count() == 0
    assert [r["k"] for r in outliers.mad_outliers(df, "t", "k").collect()] == [9]
    assert outliers.mad_outliers(df, "c", "k").count() == 0


def test_nan_is_skipped(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(99, float("nan")), (100, 900.0)],
                               "k int, x double")
    assert [r["k"] for r in outliers.iqr_outliers(df, "x", "k").collect()] == [100]


def test_mahalanobis(cloud):
    df, pdf = cloud
    x = pdf[["a", "b", "c"]].to_numpy()
    gap = x - x.mean(axis=0)
    expected = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(np.cov(x.T)), gap)
    got = outliers.mahalanobis_score(df, ["a", "b", "c"]).orderBy("key").toPandas()
    assert got["mahalanobis_score"].to_numpy() == pytest.approx(expected)
    found = outliers.mahalanobis_outliers(df, ["a", "b", "c"]).collect()
    assert {r["key"] for r in found} == {i for i in range(200) if d.chi2_sf(expected[i], 3) < 0.01}
    assert all(r["mahalanobis_p_value"] < 0.01 for r in found)
    out, kept = outliers.detect_multivariate(df, ["g"], "key", ["a", "b", "c"])
    assert out.count() + kept.count() == 200 and "g" in out.columns


def test_mahalanobis_pairs_by_brute_force(cloud):
    df, pdf = cloud
    x = pdf[["a", "b", "c"]].to_numpy()
    w = np.linalg.inv(np.cov(x.T))
    expected = {}
    for i, j in itertools.combinations(range(200), 2):
        gap = x[i] - x[j]
        dist = math.sqrt(gap @ w @ gap)
        if dist <= 0.7:
            expected[frozenset((x[i][0], x[j][0]))] = dist
    rows = outliers.mahalanobis_pairs(df, ["a", "b", "c"], 0.7).collect()
    got = {frozenset((r["left"]["a"], r["right"]["a"])): r["distance"] for r in rows}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_outlier_rows_and_rest_partition_the_table(spark, cloud):
    df, _ = cloud
    found = outliers.iqr_outliers(df, "a", "key")
    rest = table.remove_rows_by_key(df, found, "key")
    assert found.count() + rest.count() == 200


def test_components(spark, cloud):
    df, pdf = cloud
    model = multivariate.pca_fit(df, ["a", "b", "c"], 3)
    x = pdf[["a", "b", "c"]].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert model.eigenvalues == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1])
    scores = multivariate.pca_scores(df, model).orderBy("key").toPandas()
    assert scores["pc1"].to_numpy() == pytest.approx(z @ model.vectors[0])
    variance = multivariate.pca_variance(spark, model).toPandas()
    assert variance["percent"].sum() == pytest.approx(100.0)
    assert multivariate.pca_fit(df, ["a", "b", "c"], 0.5).k == 1
    loadings = multivariate.pca_loadings(spark, model).toPandas()
    assert loadings.groupby("pc")["loading"].sum().to_numpy() == pytest.approx(np.ones(3))


def test_pca_outliers_by_brute_force(cloud):
    df, pdf = cloud
    got = multivariate.pca_outliers(df, ["a", "b", "c"], ["key"], 0.95).orderBy("key").toPandas()
    model = multivariate.pca_fit(df, ["a", "b", "c"], 0.95)
    p = []
    for row in got.itertuples():
        scores = [getattr(row, f"pc{i + 1}") for i in range(model.k)]
        tails = [d.chi2_sf(s * s / v, 1) for s, v in zip(scores, model.eigenvalues, strict=True)]
        p.append(d.chi2_sf(-2 * sum(math.log(t) for t in tails), 2 * model.k))
    assert got["p_value"].to_numpy() == pytest.approx(p, abs=1e-12)
    order = np.argsort(p)
    adjusted = np.minimum.accumulate((np.array(p)[order] * 200 / np.arange(1, 201))[::-1])[::-1]
    flags = np.empty(200, bool)
    flags[order] = adjusted <= 0.05
    assert got["ht2"].tolist() == flags.tolist()
    assert got.loc[5, "both"]


def test_anova_hand_worked(spark):
    rows = [("a", v) for v in (6, 8, 4, 5, 3, 4)] + [("b", v) for v in (8, 12, 9, 11, 6, 8)] + [
        ("c", v) for v in (13, 9, 11, 8, 7, 12)]
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, y double")
    line = hypotheses.anova_oneway(df, "y", "g").filter("source = 'g'").first()
    assert (line["df"], line["sum_sq"]) == (2, pytest.approx(84.0))
    assert line["f"] == pytest.approx(9.264705882)
    assert line["p"] == pytest.approx(0.002398777, abs=1e-8)
    two = hypotheses.anova_unbalanced(df, "y", ["g"])
    assert two.filter("source = 'g'").first()["f"] == pytest.approx(line["f"])
    tukey = {(r["a"], r["b"]): r for r in hypotheses.tukey_hsd(df, "y", "g").collect()}
    assert tukey["a", "b"]["diff"] == pytest.approx(4.0) and tukey["a", "b"]["reject"]
    assert tukey["b", "c"]["low"] < 0 < tukey["b", "c"]["high"] and not tukey["b", "c"]["reject"]
    games = {(r["a"], r["b"]): r for r in hypotheses.pairwise_tukey(df, "y", "g").collect()}
    assert games["a", "b"]["p_tukey"] == pytest.approx(tukey["a", "b"]["p_adj"])


def test_two_factor_anova_balanced_splits_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [(a, b, float(rng.normal() + 2 * (a == "x"))) for a in "xy" for b in "pqr" for _ in range(8)]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    parts = hypotheses.anova_unbalanced(df, "y", ["a", "b"]).toPandas()
    y = np.array([r[2] for r in rows])
    assert parts["sum_sq"].sum() == pytest.approx(((y - y.mean()) ** 2).sum())
    assert parts["df"].sum() == len(rows) - 1
    assert parts["effect"].dropna().between(0, 1).all()


def test_manova_with_one_response_is_anova(spark, cloud):
    df, _ = cloud
    anova = hypotheses.anova_oneway(df, "a", "g").filter("source = 'g'").first()
    for row in hypotheses.manova(df, ["a"], "g").collect():
        assert row["f"] == pytest.approx(anova["f"])
        assert row["p"] == pytest.approx(anova["p"])


def test_pvalue_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "k int, p double")
    # fixed values: worked by hand from the definitions
    expected = {
        "bonferroni": [0.05, 0.2, 0.15, 0.025, 1.0],
        "holm": [0.04, 0.09, 0.09, 0.025, 0.8],
        "fdr_bh": [0.025, 0.05, 0.05, 0.025, 0.8],
    }
    for method, values in expected.items():
        rows = hypotheses.adjust_pvalues(df, "p", method).orderBy("k").collect()
        assert [r["corrected"] for r in rows] == pytest.approx(values)
        assert [r["reject"] for r in rows] == [v <= 0.05 for v in values]


def test_shapiro_on_published_sample(spark):
    # fixed values: the worked example of the 1965 paper (weights of 11 men); W = 0.79
    weights = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(float(w),) for w in weights], "x double")
    row = hypotheses.shapiro_wilk(df, "x").first()
    assert row["statistic"] == pytest.approx(0.789, abs=2e-3)
    assert row["p"] == pytest.approx(0.0067, abs=5e-4)


def test_shapiro_chunks_of_ties(spark, monkeypatch):
    values = [1.0] * 30 + [2.0] * 50 + [3.0] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    plain = hypotheses.shapiro_wilk(df, "x").first()
    monkeypatch.setattr(hypotheses, "SCORE_CHUNK", 7)
    cut = hypotheses.shapiro_wilk(df, "x").first()
    assert plain["statistic"] == pytest.approx(cut["statistic"])
    normal = spark.createDataFrame([(d.normal_ppf((i + 0.5) / 300),) for i in range(300)], "x double")
    assert hypotheses.shapiro_wilk(normal, "x").first()["p"] > 0.99
    assert hypotheses.shapiro_wilk(normal.limit(2), "x").first()["statistic"] is None


def test_intervals_cover_the_mean(cloud):
    df, pdf = cloud
    for row in profile.group_interval(df, "a", "g").collect():
        part = pdf[pdf.g == row["g"]].a
        half = d.t_ppf(0.975, len(part) - 1) * part.std() / math.sqrt(len(part))
        assert (row["ci_high"] - row["ci_low"]) / 2 == pytest.approx(half)
    widths = hypotheses.tukey_intervals(df, "a", "g").toPandas()
    assert np.ptp(widths["high"] - widths["low"]) == pytest.approx(0.0, abs=1e-9)  # equal sizes


def test_report_composes(cloud):
    df, _ = cloud
    report = reports.anova_report(df, "a", "g")
    assert report["comparisons"].count() == 6
    verdict = {r["assumption"]: r["holds"] for r in reports.assumptions_verdict(report).collect()}
    assert verdict["normal residuals"] is False


def test_kde_integrates_to_one(cloud):
    df, pdf = cloud
    curve = charts.kde(df, "b", "g").toPandas()
    for _, part in curve.groupby("hue"):
        part = part.sort_values("x")
        assert np.trapezoid(part["density"], part["x"]) == pytest.approx(1.0, abs=5e-3)


def test_qq_and_box(cloud):
    df, pdf = cloud
    points = charts.qq_points(df, "b").toPandas().sort_values("rank")
    assert points["theoretical"].is_monotonic_increasing and len(points) == 200
    assert (points["low"] < points["theoretical"]).all()
    box = charts.box_stats(df, "a").first()
    q1, q3 = np.quantile(pdf.a, [0.25, 0.75])
    inside = pdf.a[(pdf.a >= q1 - 1.5 * (q3 - q1)) & (pdf.a <= q3 + 1.5 * (q3 - q1))]
    assert box["whisker_high"] == pytest.approx(inside.max())
    assert box["fliers"] == 200 - len(inside)


def test_bootstrap_is_reproducible(cloud):
    df, _ = cloud
    first = charts.bar_means(df, "g", ["a"], keys=["key"]).orderBy("g").toPandas()
    again = charts.bar_means(df.repartition(6), "g", ["a"], keys=["key"]).orderBy("g").toPandas()
    assert first["low"].to_numpy() == pytest.approx(again["low"].to_numpy())
    assert (first["low"] <= first["mean"]).all() and (first["mean"] <= first["high"]).all()


def test_consensus(cloud):
    df, _ = cloud
    found = outliers.detect_univariate(df, ["g"], "key", ["a", "b"])
    agreed = table.consensus_outliers([found], "key", 3)
    assert 5 in {r["key"] for r in agreed.collect()}
    assert found.select(F.col("g")).filter("g is null").count() == 0
