"""Products of many columns against pandas."""

import numpy as np
import pandas as pd
import pytest

from quadrat.operators.profile import correlation_pairs, covariance_pairs


def sample(n: int, p: int) -> pd.DataFrame:
    rng = np.random.default_rng(3)
    rows = pd.DataFrame(rng.normal(size=(n, p)) + 1e6, columns=[f"x{k}" for k in range(p)])
    rows["x1"] = rows["x0"] * 2 + rng.normal(size=n)
    rows["x2"] = 7.3
    rows.loc[rng.random(n) < 0.3, "x3"] = np.nan
    rows.loc[rng.random(n) < 0.5, f"x{p - 1}"] = np.nan
    rows["x4"] = np.nan
    rows.loc[5, "x4"] = 1.0
    return rows


def matrix(df, names: list[str]) -> np.ndarray:
    out = np.full((len(names), len(names)), np.nan)
    place = {c: k for k, c in enumerate(names)}
    for x, y, r in df.toPandas().itertuples(index=False):
        out[place[x], place[y]] = out[place[y], place[x]] = np.nan if r is None else r
    return out


@pytest.mark.parametrize("p", [70, 200])
def test_equals_pandas(spark, p):
    rows = sample(300, p)
    df, names = spark.createDataFrame(rows).repartition(5), list(rows.columns)
    off = ~np.eye(p, dtype=bool)
    want = rows.corr(min_periods=2).to_numpy()
    np.testing.assert_allclose(matrix(correlation_pairs(df, names), names)[off], want[off], atol=1e-8)
    np.testing.assert_allclose(matrix(covariance_pairs(df, names), names), rows.cov(min_periods=2).to_numpy(), atol=1e-8)


def test_thousand_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 1000))
    names = [f"x{k}" for k in range(1000)]
    df = spark.createDataFrame([(row,) for row in x.tolist()], "v array<double>").repartition(4).selectExpr(*[f"v[{k}] AS x{k}" for k in range(1000)])
    found = correlation_pairs(df, names)
    assert found.count() == 1000 * 999 // 2
    np.testing.assert_allclose(matrix(found, names)[0, 1:], np.corrcoef(x.T)[0, 1:], atol=1e-10)


def test_no_rows(spark):
    names = [f"x{k}" for k in range(65)]
    none = spark.range(0).selectExpr(*[f"CAST(id AS double) AS {c}" for c in names])
    found = covariance_pairs(none, names)
    assert (found.count(), found.where("r IS NULL").count()) == (65 * 66 // 2,) * 2
