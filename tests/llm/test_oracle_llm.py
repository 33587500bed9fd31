"""The corpus queries that SQL can express give the same rows in DuckDB."""

import duckdb
import pytest

from quillon.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = queries.queries()[name](spark, DIR)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(str(x) for x in r) for r in result.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want and want
