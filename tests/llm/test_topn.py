import random

from strataspark.llm.topn import bounds, local_best, newest, top_n

SCHEMA = "g string, item string, n bigint, v int, rank int, __s string"


def brute(rows, n):
    last = {}
    for g, item, score, v, *_ in rows:
        if score is not None:
            key = (v is not None, v or 0, score)
            last[g, item] = max(last.get((g, item), key), key)
    out = set()
    for g in {g for g, _ in last}:
        best = sorted((-k[2], item is not None, (item or "").encode()) for (x, item), k in last.items() if x == g)
        out |= {(g, i.decode() if there else None, -s, r + 1) for r, (s, there, i) in enumerate(best[:n])}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    items = [None, "", "a", "B", "b", "é", "中", *[f"i{k}" for k in range(60)]]
    rows = [(rng.choice(["hot"] * 8 + ["x", "y", None]), rng.choice(items), rng.choice([None, 1, 1, 2, 3, 9]), rng.choice([None, 1, 2, 2]), 1, "clash") for _ in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for n, parts in ((1, 4), (5, 1), (5, 8), (5, None), (500, 3)):
        got = {tuple(r) for r in top_n(df, "g", "item", "n", n, "v", parts).collect()}
        assert got == brute(rows, n)


def test_bounds_are_lower_bounds_of_every_group(spark):
    rng = random.Random(5)
    rows = [(g, f"i{k}", rng.randrange(50), 1, 1, "") for g, size in (("hot", 2000), ("mid", 60), ("small", 7), (None, 100)) for k in range(size)]
    local = local_best(newest(spark.createDataFrame(rows, SCHEMA), "g", "item", "n", "v", 4), 5)
    got = {r["__g"].g: (r["__bs"], r["__bi"]) for r in bounds(local, 5).collect()}
    assert set(got) == {"hot", "mid", None}  # no part of the small group holds 5 items
    for g, (s, i) in got.items():
        assert sum((-x[2], x[1]) <= (-s, i) for x in rows if x[0] == g) >= 5


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "item", "n", 3, "v").count() == 0
