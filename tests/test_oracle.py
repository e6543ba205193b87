import pytest

from __spark_entry__ import entry, oracle_sql, queries
from hostlens.plans.oracle import ORACLE
from hostlens.plans.queries import QUERIES
from oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert queries().items() >= QUERIES.items() and oracle_sql().items() >= ORACLE.items()


def test_entry(spark):
    assert entry(spark).count() == 12


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert differences(spark, duck, name, QUERIES[name], ORACLE[name], FOLDER) == []


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith("stream_")])
def test_no_query_pairs_all_rows(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
