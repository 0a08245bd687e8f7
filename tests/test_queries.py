"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF
from tests.oracle import compare, connect

CHECKS = oracle_sql()
RUNS = queries()
SLOW = {n for n in RUNS if n.startswith(("smote_", "learner_", "vote_"))}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_sql(spark, con, name):
    problem, _ = compare(spark, con, SF, name, RUNS[name], CHECKS[name])
    assert not problem


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(CHECKS) - SLOW))
def test_gives_rows(spark, name):
    assert RUNS[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 4


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(RUNS)
