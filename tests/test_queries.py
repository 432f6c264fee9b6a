"""Every query with SQL gives the SQL's rows at the smallest scale."""

import glob
import os

import duckdb
import numpy as np
import pytest

from parallax import queries as Q




@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, (float, np.floating)):
            return round(float(v), 6) + 0.0
        return int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v

    df = df[sorted(df.columns)].astype(object)
    out = [tuple(plain(v) for v in r) for r in df.where(df.notna(), None).values.tolist()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, small, tables, name):
    got = Q.queries()[name](spark, small).toPandas()
    want = tables.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
