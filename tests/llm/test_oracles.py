"""The corpus queries that have a DuckDB twin, on the smallest tables; and that all queries are registered."""

import os

import duckdb
import pytest

import __spark_entry__
from engram.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
