"""The driver's contract, and SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_contract():
    found, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(found) and len(found) > 40


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    spark_rows = entry.queries()[name](spark, DATA)
    twin = con.sql(entry.oracle_sql()[name])
    assert sorted(spark_rows.columns) == sorted(twin.columns)
    columns = sorted(twin.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in spark_rows.collect()), key=repr)
    places = [twin.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in places) for r in twin.fetchall()), key=repr)
    assert rows == want
