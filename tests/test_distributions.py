"""The distribution kernel against the JVM's commons-math and published tables."""

import math

import pytest
from pyspark.sql import functions as F

from quadrat.functions import distributions as d


@pytest.fixture(scope="module")
def jvm(spark):
    return spark._jvm.org.apache.commons.math3.distribution


@pytest.mark.parametrize("df", [1, 2, 3, 4, 10, 55, 300])
def test_chi2(jvm, df):
    other = jvm.ChiSquaredDistribution(float(df))
    for x in (0.1, 1.0, 3.7, df * 1.0, df * 2.5):
        assert d.chi2_sf(x, df) == pytest.approx(1 - other.cumulativeProbability(x), abs=1e-10)
    for p in (0.01, 0.5, 0.95, 0.99):
        assert d.chi2_ppf(p, df) == pytest.approx(other.inverseCumulativeProbability(p), rel=1e-7)


@pytest.mark.parametrize("df", [1, 2, 5, 30, 1000])
def test_t(jvm, df):
    other = jvm.TDistribution(float(df))
    for x in (-2.0, 0.0, 0.3, 1.96, 7.0):
        assert d.t_sf(x, df) == pytest.approx(1 - other.cumulativeProbability(x), abs=1e-10)
    for p in (0.025, 0.9, 0.975):
        assert d.t_ppf(p, df) == pytest.approx(other.inverseCumulativeProbability(p), rel=1e-6)


@pytest.mark.parametrize("df", [(1, 5), (3, 40), (4, 9995), (12, 2)])
def test_f(jvm, df):
    other = jvm.FDistribution(float(df[0]), float(df[1]))
    for x in (0.2, 1.0, 2.5, 9.0):
        assert d.f_sf(x, *df) == pytest.approx(1 - other.cumulativeProbability(x), abs=1e-9)


# fixed values: 95 % points of the studentised range, as printed in statistics tables
@pytest.mark.parametrize(
    ("k", "df", "q"),
    [(2, 10, 3.151), (3, 10, 3.877), (3, 20, 3.578), (4, 60, 3.737), (5, 120, 3.917),
     (10, 30, 4.824), (3, 5, 4.602)],
)
def test_studentized_range(k, df, q):
    assert d.studentized_range_ppf(0.95, k, df) == pytest.approx(q, abs=2e-3)
    assert d.studentized_range_sf(q, k, df) == pytest.approx(0.05, abs=2e-4)


def test_two_group_range_is_t():
    assert d.studentized_range_sf(2.0 * math.sqrt(2), 2, 17) == pytest.approx(
        2 * d.t_sf(2.0, 17), abs=1e-7
    )


def test_columns(spark):
    row = spark.range(1).select(
        d.chi2_sf_column(F.lit(3.0), 3).alias("a"),
        d.chi2_sf_column(F.lit(3.0), 4).alias("b"),
        d.chi2_sf_column(F.lit(2.0), 7).alias("g"),
        d.normal_ppf_column(F.lit(0.975)).alias("c"),
        d.f_sf_column(F.lit(None).cast("double"), 1, 2).alias("e"),
    ).first()
    assert row["a"] == pytest.approx(d.chi2_sf(3.0, 3))
    assert row["g"] == pytest.approx(d.chi2_sf(2.0, 7))
    assert row["b"] == pytest.approx(d.chi2_sf(3.0, 4))
    assert row["c"] == pytest.approx(1.959964, abs=1e-6)
    assert row["e"] is None
