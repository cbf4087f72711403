"""Every registered lattice query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from fieldloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, tables, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got
    if name in ORACLE_SQL:
        rows = tables.sql(ORACLE_SQL[name])
        assert sorted(rows.columns) == columns
        at = [rows.columns.index(c) for c in columns]
        assert got == sorted(repr(tuple(r[k] for k in at)) for r in rows.fetchall())


def test_registry():
    import __spark_entry__ as registry

    assert set(QUERIES) <= set(registry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())
