"""Registered queries against DuckDB over the smallest tables."""

import duckdb
import pytest

from vigilstream.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "part")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [list(rel.columns).index(c) for c in names]
    assert found == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_gives_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
