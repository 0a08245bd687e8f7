"""Shared session and tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    """One local session for all tests."""
    return session(4)


@pytest.fixture(scope="session")
def table(spark):
    """Reader of the smallest test tables."""
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def small(spark):
    """Hand-made rows with gaps: ``k, x, g``."""
    rows = [
        (1, 1.0, "a"), (2, 2.0, "a"), (3, None, "b"), (4, float("nan"), None), (5, 4.0, "b"),
        (6, 4.0, None), (7, 10.0, "c"),
    ]
    return spark.createDataFrame(rows, "k bigint, x double, g string")
