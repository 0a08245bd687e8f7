"""Null rules, edge cases and brute-force checks of the table operators."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.operators import features, kendall, profile, quantiles, sampling, table


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_filters_keep_nulls(small):
    assert sorted(column(table.drop_rows_equal(small, "g", "a"), "k")) == [3, 4, 5, 6, 7]
    assert sorted(column(table.filter_rows(small, "g != 'a'"), "k")) == [3, 4, 5, 6, 7]
    assert sorted(column(table.filter_rows(small, "g != 'a'", keep_nulls=False), "k")) == [3, 5, 7]
    quoted = small.withColumn("g", F.lit("x != 'y'"))
    assert table.filter_rows(quoted, "g = 'x != ''y'''").count() == 7


@pytest.mark.parametrize(
    "condition, keys",
    [
        ("b + a != 3", [2, 3, 4]), ("a + 1 != 9", [1, 2, 3, 4]), ("a != b - 1", [3, 4]), ("g != upper('x') and a != 5", [1, 3, 4]),
        ("(a != 1 or b <> 2) and g is not null", [2, 3]), ("not (a != 1)", [1]), ("case when a != 1 then true else false end", [2, 3, 4]),
    ],
)
def test_unequal_over_expressions(spark, condition, keys):
    df = spark.createDataFrame([(1, 1, 2, "x"), (2, 5, 6, "X"), (3, None, 2, "z"), (4, 7, None, None)], "k int, a int, b int, g string")
    assert sorted(column(table.filter_rows(df, condition), "k")) == keys


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, nan), (2, nan, nan), (3, None, 1.0), (4, nan, 2.0)], "k int, x double, y double")
    assert {r["feature"]: r["missing"] for r in profile.missing_table(df).collect()} == {"x": 3, "y": 2}
    assert {r["column"]: r["missing"] for r in table.columns_with_nulls(df).collect()} == {"x": 3, "y": 2}
    assert features.drop_sparse_features(df, ["x", "y"], 0.7).columns == ["k", "y"]
    assert features.drop_sparse_rows(df, ["x", "y"], None).count() == 0
    assert {r["pattern"]: r["rows"] for r in profile.missing_patterns(df, ["k"]).collect()} == {"10": 1, "00": 1, "01": 2}


def test_ranks_of_large_integers(spark):
    df = spark.createDataFrame([(i, 2**53 + i // 2) for i in range(8)], "k bigint, v bigint")
    ranked = quantiles.rank_global(df, "v", ["k"]).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 9))
    assert sorted(ranked, key=lambda r: r["rank"])[0]["v"] == 2**53


def test_unknown_column_is_an_error(small):
    with pytest.raises(KeyError):
        table.drop_columns(small, ["nope"])


def test_cast_later_list_wins(small):
    out = table.cast_columns(small, category=["g"], integer=["k"], string=["k"])
    assert dict(out.dtypes)["k"] == "string"
    assert out.schema["g"].metadata == {"role": "category"}
    assert table.select_categorical(out)[1] == ["g"]
    lenient = table.cast_columns(small.withColumn("t", F.lit("no")), integer=["t"], lenient=True)
    assert column(lenient, "t") == [None] * 7


def test_duplicate_names(small):
    twice = small.select("k", "x", F.lit(1).alias("k"))
    assert table.drop_duplicate_names(twice).columns == ["k", "x"]


def test_concat_columns_rejects_repeated_keys(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, a int")
    b = spark.createDataFrame([(1, 5)], "k int, b int")
    with pytest.raises(Exception, match="repeats a key"):
        table.concat_columns([a, b], "k").collect()


def test_records(spark):
    rows = table.records_to_table(spark, {"a": 1, "b": 2.5}).collect()
    assert [tuple(r) for r in rows] == [("a", 1.0), ("b", 2.5)]


def test_match_names_by_brute_force(spark):
    rng = random.Random(1)
    stems = ["".join(rng.choices("ab_", k=rng.randint(1, 9))) for _ in range(60)]
    names = ["".join(rng.choices("ab_", k=rng.randint(1, 3))) for _ in range(15)] + ["zzz"]
    s = spark.createDataFrame([(x,) for x in stems], "stem string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {tuple(r) for r in table.match_names(s, "stem", n, "name").select("name", "stem").collect()}
    assert got == {(a, b) for a in set(names) for b in set(stems) if a in b}
    files = {r["name"]: r["files"] for r in table.match_files(s, "stem", n, "name").collect()}
    assert files["zzz"] == 0


@pytest.mark.parametrize("limit", [50_000, 20, 3])
def test_quantiles_by_brute_force(spark, monkeypatch, limit):
    """Whole ordering for small groups, sketch brackets beyond, narrowed brackets last; ties, skew and three sizes."""
    monkeypatch.setattr(quantiles, "ORDERED", limit)
    rng = np.random.default_rng(3)
    values = np.concatenate(
        [rng.normal(size=4000), np.full(3000, 7.0), rng.pareto(1, 2000), [1.0, 2.0]]
    )
    groups = np.array(["a"] * 6000 + ["b"] * 3000 + ["c"] * 2)
    pdf = pd.DataFrame({"g": groups, "v": values})
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    whole = quantiles.quantile_table(df, ["v"], probs).first()
    assert [whole[f"q{i}"] for i in range(6)] == pytest.approx(list(np.quantile(values, probs)))
    for row in quantiles.quantile_table(df, ["v"], probs, ["g"]).collect():
        expected = np.quantile(pdf[pdf.g == row["g"]].v, probs)
        assert [row[f"q{i}"] for i in range(6)] == pytest.approx(list(expected))
    mad = quantiles.robust_mad(df, ["v"]).first()["mad"]
    assert mad == pytest.approx(np.median(np.abs(values - np.median(values))) / quantiles.MAD_SCALE)


def test_wide_tables_share_a_scan(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "WIDE_TABLE", 1)
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0), (4.0, None)], "a double, b double")
    rows = {r["feature"]: r["q0"] for r in quantiles.quantile_table(df, ["a", "b"], [0.5]).collect()}
    assert rows == {"a": 2.0, "b": 5.5}


def test_profile_like_pandas(spark, small):
    row = profile.numeric_profile(small, ["x"]).first()
    x = pd.Series([1.0, 2.0, 4.0, 4.0, 10.0])
    assert (row["count"], row["missing"]) == (5, 2)
    assert row["std"] == pytest.approx(x.std())
    assert row["skew"] == pytest.approx(x.skew())
    assert row["kurt"] == pytest.approx(x.kurt())
    assert row["p25"] == pytest.approx(x.quantile(0.25))
    assert row["pct_var"] == pytest.approx(x.std() / x.mean() * 100)


def test_profile_of_empty_and_constant(spark):
    df = spark.createDataFrame([(7.0, None), (7.0, None)], "c double, n double")
    rows = {r["feature"]: r for r in profile.numeric_profile(df, ["c", "n"]).collect()}
    assert rows["c"]["mad"] == 0.0 and rows["c"]["pct_var"] == 0.0
    assert rows["n"]["count"] == 0 and rows["n"]["p50"] is None


def test_null_group_keys(small):
    means = profile.group_mean_std(small, ["g"], "x").collect()
    assert [r["g"] for r in means] == ["a"]  # singletons and gaps drop out
    counts = {r["g"]: r["x"] for r in profile.group_count(small, ["g"], ["x"]).collect()}
    assert None in counts


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    row = profile.categorical_profile(df, ["c"]).first()
    assert (row["top"], row["freq"], row["unique"], row["count"]) == ("a", 2, 2, 4)


def test_kendall_and_spearman_by_brute_force(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 12, 150).astype(float)
    b = np.round(a + rng.normal(scale=4, size=150))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    c = d = ta = tb = 0
    for i, j in itertools.combinations(range(150), 2):
        x, y = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
        c, d = c + (x * y > 0), d + (x * y < 0)
        ta, tb = ta + (x == 0), tb + (y == 0)
    pairs = 150 * 149 / 2
    tau = (c - d) / np.sqrt((pairs - ta) * (pairs - tb))
    assert kendall.kendall_tau(df, "a", "b").first()["r"] == pytest.approx(tau)
    rho = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert profile.correlation_pairs(df, ["a", "b"], "spearman").first()["r"] == pytest.approx(rho)
    gaps = df.unionByName(spark.createDataFrame([(1.0, None)], "a double, b double"))
    assert profile.correlation_pairs(gaps, ["a", "b"], "spearman").first()["r"] == pytest.approx(rho)


def test_ranks_ignore_partitioning(spark):
    values = [5.0, 1.0, 5.0, 2.0, 5.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    expected = {1.0: 1.0, 2.0: 2.0, 5.0: 4.0}
    for parts in (1, 7):
        rows = quantiles.ranked_values(df.repartition(parts), "v").collect()
        assert {r["value"]: r["rank"] for r in rows} == expected
    ranked = quantiles.rank_global(df, "v", ["k"]).collect()
    assert sorted(r["rank"] for r in ranked) == [1, 2, 3, 4, 5]


def test_splits_partition_the_rows(spark):
    df = spark.range(101).withColumn("g", F.when(F.col("id") < 90, "x").otherwise(None))
    first = {r["id"]: r["split"] for r in sampling.split_train_valid_test(df, ["id"]).collect()}
    again = sampling.split_train_valid_test(df.repartition(9), ["id"]).collect()
    assert first == {r["id"]: r["split"] for r in again}
    sizes = pd.Series(first).value_counts()
    assert (sizes["train"], sizes["valid"], sizes["test"]) == (61, 20, 20)
    folds = sampling.stratified_folds(df, "g", 5, ["id"]).groupBy("g", "fold").count().collect()
    assert {r["count"] for r in folds if r["g"] == "x"} == {18}
    assert sum(r["count"] for r in folds) == 101
    other = {r["id"]: r["split"] for r in sampling.split_train_valid_test(df, ["id"], seed=1).collect()}
    assert other != first


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (None, 7.0)], "a double, c double")
    rows = features.standardise(df, ["a", "c"]).toPandas()
    assert rows["a"].dropna().std(ddof=0) == pytest.approx(1.0)
    assert set(rows["c"]) == {0.0}
    assert features.minmax_scale(df, ["a"]).toPandas()["a"].dropna().tolist() == [0.0, 0.5, 1.0]


def test_power_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(size=3000)) - 1
    df = spark.createDataFrame(pd.DataFrame({"x": x}))

    def likelihood(power):
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.log1p(x) if power == 0 else ((x + 1) ** power - 1) / power
            down = -(((1 - x) ** (2 - power)) - 1) / (2 - power)
        y = np.where(x >= 0, up, down)
        return -len(x) / 2 * np.log(y.var()) + (power - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.linspace(-1.0005, 0.9995, 2001)
    best = max(grid, key=likelihood)
    assert features.fit_powers(df, ["x"])["x"] == pytest.approx(best, abs=2e-3)
    out = features.power_transform(df, ["x"]).toPandas()["x"]
    assert out.mean() == pytest.approx(0.0, abs=1e-9) and out.std(ddof=0) == pytest.approx(1.0)


def test_selection_rules(spark):
    rng = np.random.default_rng(4)
    n = 400
    a = rng.normal(size=n)
    pdf = pd.DataFrame({
        "a": a, "b": a, "c": 2 * a + 1e-3 * rng.normal(size=n), "d": rng.normal(size=n),
        "k": np.where(np.arange(n) < 390, "x", "y"), "t": ["same"] * n,
        "u": np.where(np.arange(n) < 100, "x", "y"),
    })
    df = spark.createDataFrame(pdf)
    assert [r[0] for r in features.duplicate_features(df, df.columns)] == ["b"]
    assert [r[0] for r in features.constant_features(df, df.columns)] == ["k", "t"]
    assert [r[0] for r in features.constant_features(df, df.columns, 0.4)] == ["k", "t", "u"]
    dropped = features.correlated_features(df, ["a", "b", "c", "d"])
    assert [(r[0], r[1]) for r in dropped] == [("b", "a"), ("c", "a")]
    earlier = column(features.correlated_to_drop(df, ["a", "b", "c", "d"]), "feature")
    assert sorted(earlier) == ["a", "b"]
    assert [r[0] for r in features.low_variance_features(df, ["a", "d"], 1e-9)] == []


def test_one_hot_unseen_is_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    rows = features.one_hot(df, "c", ["a"]).collect()
    assert sorted(r["c_a"] for r in rows) == [0, 0, 1]


def test_hot_key_ranks(spark):
    """A third of the rows share one value and one class: ranks stay exact."""
    df = spark.range(3000).withColumn("v", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7))
    ranked = sampling.hashed_rank(df, ["id"], 1, ["v"])
    tops = ranked.groupBy("v").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("d"),
                                   F.count("*").alias("n")).collect()
    assert all(r["m"] == r["d"] == r["n"] for r in tops)
