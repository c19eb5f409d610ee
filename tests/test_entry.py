"""Registered queries: every one runs; those of the evidence library give what DuckDB gives."""

import duckdb
import pytest
from lumenry.jobs import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in registry.ORACLE:
        assert got
        return
    cursor = db.execute(registry.ORACLE[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_entry_has_every_query():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
