"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

from cairn.llm.entry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want and len(want) > 40
