import datetime as dt

import pytest

from strataspark.operators.orphans import orphans, report


def day(n):
    return dt.datetime(2025, 1, n)


def test_match_semantics_of_partly_null_keys(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", "z"), (3, "a", None), (4, "q", None), (5, None, "y"), (6, None, None)], "id int, p string, q string")
    parents = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "pp string, pq string")
    on = [("p", "pp"), ("q", "pq")]
    ids = lambda match: sorted(r.id for r in orphans(refs, parents, on, match).collect())
    assert ids("simple") == [2]
    assert ids("partial") == [2, 4]
    assert ids("full") == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        orphans(refs, parents, on, "loose")


def test_heavy_composite_keys_are_broadcast(spark):
    refs = [(i, "hot", "x" if i % 2 else "gone") for i in range(400)] + [(1000 + i, f"p{i}", f"q{i}") for i in range(40)] + [(2000, "hot", None), (2001, None, "x")]
    parents = spark.createDataFrame([("hot", "x"), *((f"p{i}", f"q{i}") for i in range(0, 40, 2))], "pp string, pq string")
    df = spark.createDataFrame(refs, "id int, p string, q string")
    found = orphans(df, parents, [("p", "pp"), ("q", "pq")], sample=df, share=0.2)
    assert sorted(r.id for r in found.collect()) == [*range(0, 400, 2), *range(1001, 1040, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("broadcast") >= 2


def test_lifetimes_and_null_times(spark):
    refs = spark.createDataFrame([(i, "a", t) for i, t in enumerate([day(1), day(2), day(4), day(5), day(9), None])] + [(9, "gone", day(3))], "id int, key string, t timestamp")
    parents = spark.createDataFrame([("a", day(2), day(4)), ("a", day(5), None), ("a", day(2), day(4)), (None, day(1), None)], "key string, since timestamp, until timestamp")
    found = orphans(refs, parents, [("key", "key")], at="t", valid=("since", "until"), share=0.5)
    assert sorted(r.id for r in found.collect()) == [0, 2, 5, 9]
    found = found.withColumns({"src": found["key"]})
    assert {(r.src_table, r.references) for r in report(found, "src", "t").collect()} == {("a", 2), ("a", 1), ("gone", 1)}


def test_empty_sides(spark):
    refs = spark.createDataFrame([(1, "a")], "id int, key string")
    parents = spark.createDataFrame([], "key string")
    assert orphans(refs, parents, [("key", "key")]).count() == 1
    assert orphans(refs.limit(0), parents, [("key", "key")]).count() == 0
