"""Every query against its SQL on the small tables, and a row check for the rest."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SF = os.environ.get("SIEVELOG_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries(), oracle_sql()
#: No trend alert falls into the last seven days of the smallest tables.
EMPTY_AT_SMALL = {"p13_alerts_page"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(autouse=True)
def nothing_held(spark):
    held = lambda: set(dict(spark.sparkContext._jsc.getPersistentRDDs()))
    before = held()
    yield
    assert not held() - before, "a query holds cached rows"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    diff = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    if name in EMPTY_AT_SMALL and SF.endswith("sf0.001"):
        assert diff in (None, "no rows"), diff
    else:
        assert diff is None, diff


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry(spark).count() > 0


def test_plans_have_no_cross_join(spark):
    for name in ("f22_mongodb_features", "f23_mssql_features", "e22_false_positives", "r03_r09_rate_alerts", "d05_fifo_buffer"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
