"""Every registered query runs on the smallest tables, and matches its SQL where it has one."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairn import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in queries.ORACLE:
        assert got
        return
    rel = con.sql(queries.ORACLE[name])
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(canon(r[c]) for c in cols) for r in got) == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
