"""Every core query with SQL gives the same rows in Spark and DuckDB."""

import pytest

from lodestrata.plans import analysis, paths, problems, projects, search, services, store, stream
from tests.compare import same

MODULES = [search, store, paths, analysis, services, stream, problems, projects]
SQL = {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
QUERIES = {name: query for m in MODULES for name, query in m.queries().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    assert same(QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_names_do_not_clash():
    assert len(QUERIES) == sum(len(m.queries()) for m in MODULES)
    assert set(SQL) <= set(QUERIES)
