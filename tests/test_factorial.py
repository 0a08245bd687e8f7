"""Analysis of variance with several factors against dense least squares."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from quadrat.operators import hypotheses


def dense_type_two(rows: pd.DataFrame, factors: list[str]) -> dict[str, tuple[float, int]]:
    """Sum of squares and df per term, from the full design matrix."""
    subsets = [s for k in range(len(factors) + 1) for s in combinations(factors, k)]

    def fit(terms):
        blocks = [
            pd.get_dummies(rows[list(t)].astype(str).agg("|".join, axis=1)).to_numpy(float) if t else np.ones((len(rows), 1))
            for t in terms
        ]
        x = np.hstack(blocks)
        beta = np.linalg.lstsq(x, rows["y"].to_numpy(), rcond=1e-10)[0]
        return float(((rows["y"] - x @ beta) ** 2).sum()), int(np.linalg.matrix_rank(x, tol=1e-8))

    out = {}
    for term in subsets[1:]:
        others = [t for t in subsets if not set(term) <= set(t)]
        less, more = fit(others), fit([*others, term])
        out[" * ".join(term)] = (less[0] - more[0], more[1] - less[1])
    out["Residual"] = (fit(subsets)[0], len(rows) - fit(subsets)[1])
    return out


def sample(sizes: list[int], n: int, seed: int, hole: bool = False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    names = [chr(97 + i) for i in range(len(sizes))]
    rows = pd.DataFrame({c: (rng.integers(0, k, n) ** 2) % k for c, k in zip(names, sizes)})
    full = pd.DataFrame(np.array(np.meshgrid(*[range(k) for k in sizes])).reshape(len(sizes), -1).T, columns=names)
    rows = pd.concat([rows, full], ignore_index=True)
    if hole:
        rows = rows[~((rows.a == 0) & (rows.b != 0))].reset_index(drop=True)
    rows["y"] = rows["a"] * 0.7 + rows["a"] * rows["b"] * 0.2 + rng.normal(size=len(rows)) + 100
    return rows


@pytest.mark.parametrize(
    ("sizes", "hole", "dense"),
    [([3, 4], True, 1000), ([3, 4], False, 0), ([3, 4], True, 0), ([3, 2, 4], False, 1000), ([3, 2, 4], True, 1000), ([2, 3, 2], False, 0),
     ([2, 2, 3, 2], False, 1000)],
)
def test_equals_dense_least_squares(spark, sizes, hole, dense):
    rows = sample(sizes, 150, sum(sizes), hole)
    factors = list(rows.columns[:-1])
    got = hypotheses.anova_unbalanced(spark.createDataFrame(rows), "y", factors, dense_columns=dense).toPandas()
    want = dense_type_two(rows, factors)
    assert set(got["source"]) == set(want)
    for line in got.itertuples():
        assert line.df == want[line.source][1], line.source
        assert line.sum_sq == pytest.approx(want[line.source][0], rel=1e-6, abs=1e-7), line.source


def test_separate_parts_and_odd_rows(spark):
    """Two blocks of levels that never meet, null levels, missing numbers, one row, none."""
    rows = pd.DataFrame({"a": [0, 0, 1, 1, 2, 2, 3, 3] * 4, "b": [0, 1, 0, 1, 2, 3, 2, 3] * 4})
    rows["y"] = np.random.default_rng(5).normal(size=32)
    df = spark.createDataFrame(rows)
    for dense in (0, 1000):
        got = hypotheses.anova_unbalanced(df, "y", ["a", "b"], dense_columns=dense).toPandas().set_index("source")
        assert got["df"].to_dict() == {"a": 2, "b": 2, "a * b": 2, "Residual": 24}
    odd = df.selectExpr("a", "IF(b = 3, NULL, b) AS b", "IF(a = 0, double('NaN'), y) AS y")
    kept = hypotheses.anova_unbalanced(odd, "y", ["a", "b"]).toPandas().set_index("source")
    assert kept["df"]["Residual"] == 4 * 4 - 4
    one = hypotheses.anova_unbalanced(df.limit(1), "y", ["a", "b"]).toPandas()
    assert one["df"].tolist() == [0, 0, 0, 0] and one["f"].isna().all()
    assert hypotheses.anova_unbalanced(df.limit(0), "y", ["a", "b"]).count() == 0
    with pytest.raises(ValueError, match="different factors"):
        hypotheses.anova_unbalanced(df, "y", ["a", "a"])
