"""Every named query against its DuckDB oracle, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, con, name):
    assert difference(spark_rows(QUERIES[name](spark, SF)), duck_rows(con, ORACLE[name])) is None
