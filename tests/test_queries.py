"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def cell(x):
    if x is None or x != x:
        return "null"
    return f"{x:.7g}" if isinstance(x, float) else str(x)


def rows(table, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(cell(r[i]) for i in order) for r in table)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_and_agrees_with_itself(spark, name):
    first, second = (registry.QUERIES[name](spark, SF) for _ in range(2))
    assert rows(first.collect(), first.columns) == rows(second.collect(), second.columns) != []


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
