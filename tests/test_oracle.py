"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from folders import SF_001
from oracle import ordered, sql_rows

import __spark_entry__ as entry_points
from uptakelens.plans import sample_queries, sample_sql

QUERIES = sample_queries.all_queries()
SQL = sample_sql.all_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    result = QUERIES[name](spark, SF_001)
    columns, expected = sql_rows(SF_001, SQL[name])
    assert sorted(result.columns) == sorted(columns)
    rows = ordered(result.columns, result.collect())
    assert rows == ordered(columns, expected)
    assert rows


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
