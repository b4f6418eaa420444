from pyspark.sql import functions as F

from strataspark.operators.skew import count_distinct_by, hashed, heavy_keys, split_join


def pairs(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, n int")


def test_heavy_keys_are_bounded_and_skip_null(spark):
    df = pairs(spark, [("hot", str(i), 0) for i in range(60)] + [(f"c{i}", "x", 0) for i in range(40)] + [(None, "x", 0)] * 50)
    assert heavy_keys(df, "k", 0.1) == ["hot"]
    assert heavy_keys(df.limit(0), "k", 0.1) == []


def test_distinct_counts_equal_brute_force(spark):
    rows = [("hot", f"v{i % 70}", 0) for i in range(300)] + [(f"c{i % 9}", f"v{i % 4}", 0) for i in range(80)]
    rows += [(None, "v", 0), ("c1", None, 0), ("hot", "", 0)]
    df = pairs(spark, rows)
    want = {}
    for k, v, _ in rows:
        if k is not None and v is not None:
            want.setdefault(k, set()).add(v)
    for heavy in ([], ["hot"], ["hot", "c1", "absent"]):
        got = {r[0]: r[1] for r in count_distinct_by(df, "k", "v", heavy).collect()}
        assert got == {k: len(v) for k, v in want.items()}
    assert count_distinct_by(df.limit(0), "k", "v", ["hot"]).count() == 0


def test_split_join_equals_plain_join(spark):
    left = pairs(spark, [("hot", str(i), i) for i in range(20)] + [("a", "1", 1), ("b", "2", 2), (None, "3", 3)])
    right = spark.createDataFrame([("hot", 7), ("a", 1)], "k string, m int")
    heavy = [r[0] for r in right.where("k = 'hot'").select(hashed("k")).collect()]
    assert len(heavy) == 1
    anti = split_join(left, right, "k", heavy, "left_anti")
    assert sorted(r.v for r in anti.collect()) == ["2", "3"]
    limited = split_join(left, right, "k", heavy, "left_anti", lambda a, b: a["n"] < b["m"])
    assert limited.where(F.col("k") == "hot").count() == 13
