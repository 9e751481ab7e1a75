"""Every query that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SMALL

from skillgrid.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    where = [found.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in where)) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)
