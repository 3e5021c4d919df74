"""Every named query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


# Operators that pair every row with every row or leave the JVM.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF", "MapInPandas"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, connection, name):
    result = QUERIES[name](spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in UNWANTED if operator in plan]
    if name in ORACLES:
        assert difference(result, connection, ORACLES[name]) is None
    else:
        assert result.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
