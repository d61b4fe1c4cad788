"""Every registered query outside ``llm`` runs over the smallest tables, and those with SQL equal DuckDB's result."""

from __future__ import annotations

import pytest
from conftest import SF, compare

from tarnwick.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert rows
