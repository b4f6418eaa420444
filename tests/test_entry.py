"""The contract with the driver, and queries against SQL on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

#: Queries for which the smallest data hold nothing; other tests have fixtures for them.
EMPTY = {"p4_flat_capability_node", "mapped_cpp", "mapped_kotlin", "texts_like_tests", "layer_capabilities", "implicit_interfaces", "literal_comparisons", "literal_dispersion"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (2, 3, 4)} <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["entity_id", "dependents"]


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_equals_sql(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, data, name):
    assert entry.queries()[name](spark, data).collect() or name in EMPTY
