"""The driver's contract: every query with an oracle agrees with DuckDB over the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from docmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
