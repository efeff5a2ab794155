"""Every registered query runs on the smallest tables and equals its SQL, if it has one."""

import os

import duckdb
import pytest

from strataline import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    return "None" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        assert sorted(tuple(norm(row[rel.columns.index(c)]) for c in cols) for row in rel.fetchall()) == got
    else:
        assert got
