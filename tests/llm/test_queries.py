import pytest

from lodestrata.llm import queries
from tests.compare import same

SQL = queries.oracle_sql()
QUERIES = queries.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    assert same(QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    # The small tables need not have a significant length.
    assert QUERIES[name](spark, data).count() > 0 or name == "p10_limits"
