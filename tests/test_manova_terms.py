"""Multivariate analysis per term against least squares with and without the term's columns."""

import numpy as np
import pandas as pd
import pytest

from quadrat.operators import hypotheses
from quadrat.operators.multiresponse import manova_terms


def sample(n: int = 120) -> pd.DataFrame:
    rng = np.random.default_rng(11)
    rows = pd.DataFrame({"g": rng.choice(list("aabc"), n), "h": rng.choice(["u", "v"], n), "x": rng.normal(50, 3, n)})
    rows["y1"] = (rows.g == "b") * 0.8 + rows.x * 0.1 + rng.normal(size=n) + 1000
    rows["y2"] = (rows.h == "v") * 0.5 + rng.normal(size=n) - 3
    return rows


def design(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    b, c, v = (rows.g == "b"), (rows.g == "c"), (rows.h == "v")
    x = rows.x.to_numpy()
    return {
        "Intercept": np.ones((len(rows), 1)), "g": np.c_[b, c].astype(float), "h": np.c_[v].astype(float), "x": np.c_[x],
        "g * h": np.c_[b & v, c & v].astype(float), "h * x": np.c_[v * x],
    }


def test_equals_least_squares(spark):
    rows = sample()
    terms = ["g", "h", "x", ("g", "h"), ("h", "x")]
    got = manova_terms(spark.createDataFrame(rows), ["y1", "y2"], terms).toPandas()
    blocks, y = design(rows), rows[["y1", "y2"]].to_numpy()

    def errors(names):
        x = np.hstack([blocks[n] for n in names])
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return left.T @ left

    e = errors(blocks)
    assert set(got["term"]) == set(blocks)
    for name in blocks:
        h = errors([n for n in blocks if n != name]) - e
        roots = np.linalg.eigvals(np.linalg.solve(e, h)).real
        line = got[got["term"] == name].set_index("statistic")["value"]
        assert line["Wilks' lambda"] == pytest.approx(np.linalg.det(e) / np.linalg.det(e + h), rel=1e-6), name
        assert line["Pillai's trace"] == pytest.approx((roots / (1 + roots)).sum(), rel=1e-6), name
        assert line["Roy's greatest root"] == pytest.approx(roots.max(), rel=1e-6), name


def test_one_factor_equals_manova(spark):
    df = spark.createDataFrame(sample())
    one = hypotheses.manova(df, ["y1", "y2"], "g").toPandas().set_index("statistic")
    got = manova_terms(df, ["y1", "y2"], ["g"]).where("term = 'g'").toPandas().set_index("statistic")
    for name in ("value", "df1", "df2", "f", "p"):
        assert got[name].to_dict() == pytest.approx(one[name].to_dict(), rel=1e-7)


def test_aliased_missing_and_empty(spark):
    df = spark.createDataFrame(sample())
    twice = df.selectExpr("*", "2 * x + 1 AS z", "CAST(g AS string) AS g2")
    got = manova_terms(twice, ["y1", "y2"], ["g", "x", "z", "g2"]).toPandas()
    assert set(got["term"]) == {"Intercept", "g", "x"}  # z and g2 add no column
    gaps = twice.selectExpr("IF(g = 'c', NULL, g) AS g", "IF(h = 'u' AND x > 50, double('NaN'), y1) AS y1", "y2")
    left = gaps.where("g IS NOT NULL AND NOT isnan(y1)")
    assert manova_terms(gaps, ["y1", "y2"], ["g"]).collect() == manova_terms(left, ["y1", "y2"], ["g"]).collect()
    assert manova_terms(df.limit(0), ["y1", "y2"], ["g"]).count() == 0
    assert manova_terms(df.limit(2), ["y1", "y2"], ["g"]).count() == 0
    assert manova_terms(df.withColumn("y2", df.y1 * 2), ["y1", "y2"], ["g"]).count() == 0  # no error matrix to divide by
    with pytest.raises(ValueError, match="different terms"):
        manova_terms(df, ["y1"], ["g", "g"])
