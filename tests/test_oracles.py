import pytest
from compare import DATA, database, rows_of, rows_of_sql

from loomgraph.plans import registry


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    assert rows_of(registry.QUERIES[name](spark, DATA)) == rows_of_sql(con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).columns
