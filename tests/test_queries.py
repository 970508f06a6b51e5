"""Every registered query of the engine's own operators runs; those with SQL equal DuckDB."""

import duckdb
import pytest

from tessera.plans import queries as core

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, small, db, name):
    got = core.QUERIES[name](spark, small).toPandas()
    if name in core.ORACLE_SQL:
        want = db.sql(core.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry():
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
