"""Corrections of p-values in families of any size against the row-by-row rules."""

import numpy as np
import pandas as pd
import pytest

from quadrat.operators.hypotheses import adjust_pvalues
from quadrat.operators.quantiles import running_extreme


def by_rule(p: np.ndarray, method: str) -> np.ndarray:
    """Corrected values of one family, missing ones left out."""
    out = np.full(len(p), np.nan)
    there = np.flatnonzero(~np.isnan(p))
    at = there[np.argsort(p[there], kind="stable")]
    x, m = p[at], len(at)
    i = np.arange(1, m + 1)
    if method == "holm":
        v = np.maximum.accumulate(x * (m - i + 1))
    elif method in ("fdr_bh", "fdr_by"):
        whole = (1.0 / i).sum() if method == "fdr_by" else 1.0
        v = np.minimum.accumulate((x * m / i * whole)[::-1])[::-1]
    else:
        v = x * m if method == "bonferroni" else 1 - (1 - x) ** m
    out[at] = np.minimum(v, 1.0)
    return out


@pytest.mark.parametrize("method", ["bonferroni", "sidak", "holm", "fdr_bh", "fdr_by"])
@pytest.mark.parametrize("family", [[], ["g"]])
def test_equals_rule(spark, method, family):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"k": range(600), "g": rng.choice(["a", "a", "b", None], 600), "p": rng.random(600).round(2) ** 3})
    rows.loc[rng.random(600) < 0.3, "p"] = 0.001  # a hot value
    rows.loc[rng.random(600) < 0.1, "p"] = np.nan
    df = spark.createDataFrame(rows, "k long, g string, p double").repartition(7)
    got = adjust_pvalues(df, "p", method, family=family).toPandas().sort_values("k").reset_index(drop=True)
    assert list(got.columns) == ["k", "g", "p", "corrected", "reject"]
    assert len(got) == 600
    groups = [np.arange(600)] if not family else [np.flatnonzero((rows.g == v) if v else rows.g.isna()) for v in ("a", "b", None)]
    for at in groups:
        want = by_rule(rows.p.to_numpy()[at], method)
        np.testing.assert_allclose(got.corrected.to_numpy(float)[at], want, rtol=1e-9)
    assert got.reject[rows.p.isna()].isna().all()


def test_harmonic_number_of_a_large_family(spark):
    df = spark.range(5000).selectExpr("id", "1e-7 * (id + 1) AS p")
    got = adjust_pvalues(df, "p", "fdr_by").orderBy("id").toPandas()
    np.testing.assert_allclose(got.corrected, by_rule(got.p.to_numpy(), "fdr_by"), rtol=1e-12)


def test_extremes_from_the_end_take_one_pass(spark):
    """No window reaches the end of its partition, which Spark would go over again for every row."""
    rows = spark.range(60_000).selectExpr("id", "(id * 7919) % 60000 AS v").repartition(5)
    for kind, rule in (("min", np.minimum), ("max", np.maximum)):
        out = running_extreme(rows, "id", "v", kind)
        assert "FOLLOWING" not in out._jdf.queryExecution().toString().upper()
        got = out.orderBy("id").toPandas()
        v = got.v.to_numpy()
        want = rule.accumulate(v[::-1])[::-1] if kind == "min" else rule.accumulate(v)
        np.testing.assert_array_equal(got.extreme, want)


def test_no_rows_and_unknown_method(spark):
    none = spark.range(0).selectExpr("id", "CAST(id AS double) AS p")
    for method in ("sidak", "holm", "fdr_by"):
        assert adjust_pvalues(none, "p", method).count() == 0
    with pytest.raises(ValueError, match="unknown method"):
        adjust_pvalues(none, "p", "none")
