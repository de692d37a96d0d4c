"""Every query with SQL returns the rows that DuckDB returns, on the smallest tables."""

import math

import duckdb
import pytest

from passagework.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=str)
    answer = duck.execute(catalogue.oracle_sql()[name])
    named = [x[0] for x in answer.description]
    assert sorted(named) == columns
    want = sorted((tuple(plain(r[named.index(c)]) for c in columns) for r in answer.fetchall()), key=str)
    assert got == want and got
