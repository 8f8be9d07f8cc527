"""Every reference query against its oracle at the smallest scale."""

import os

import duckdb
import pytest

from cairn.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, duck, name):
    f, sql = REGISTRY[name]
    df = f(spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert got == want
