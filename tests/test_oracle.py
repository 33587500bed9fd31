"""Every query with an oracle gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from quillon.plans import registry

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names) for r in result.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
