"""All queries on the smallest tables; those with SQL against it."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, views

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [q for q in QUERIES if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", [q for q in OWN if q in SQL])
def test_equals_its_sql(spark, sf, con, name):
    compare(spark, con, name, sf, QUERIES, SQL)


@pytest.mark.parametrize("name", [q for q in OWN if q not in SQL])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
