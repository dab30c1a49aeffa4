"""Queries of this subpackage against their SQL, on whole tables."""

from __future__ import annotations

import pytest
from helpers import SF_001
from oracle import ordered, sql_rows

from uptakelens.llm import queries

SQL = queries.all_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    result = queries.all_queries()[name](spark, SF_001)
    columns, expected = sql_rows(SF_001, SQL[name])
    assert sorted(result.columns) == sorted(columns)
    rows = ordered(result.columns, result.collect())
    assert rows == ordered(columns, expected)
    assert rows


def test_every_operator_has_one_query():
    names = sorted(queries.all_queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
