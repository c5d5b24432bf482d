"""Every named query against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in os.listdir(data):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{data}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, data, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[k]) for k in at) for r in res.fetchall()), key=str)
