"""Queries that SQL can express, against their SQL."""

import os

import pytest

from viewloom.llm import queries

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    bag = lambda frame: sorted(map(repr, frame.astype(object).itertuples(index=False, name=None)))
    assert bag(got) == bag(want)
