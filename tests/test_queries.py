"""Every registered query against its SQL, and rules every registered query keeps."""

import os

import pytest

import __spark_entry__ as registry
from checks.compare import connect, difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
# Searches and whole trainings, minutes each: the comparison of all queries runs them, their parts have tests of their own.
SLOW = {"rf_grid", "window_grid", "cross_session_eval", "detector_overview"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert registry.entry(spark).count() > 0
