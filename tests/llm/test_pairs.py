import itertools
import math
import random
from collections import Counter

import pytest

from strataspark.llm.pairs import frequent_pairs


def brute(rows, least, lift):
    baskets = {}
    for s, b, i, *_ in rows:
        if None not in (s, b, i):
            baskets.setdefault((s, b), set()).add(i)
    total, single, both = Counter(), Counter(), Counter()
    for (s, _), items in baskets.items():
        total[s] += 1
        single.update((s, i) for i in items)
        both.update((s, *p) for p in itertools.combinations(sorted(items, key=str.encode), 2))
    return {
        (s, a, b, n, single[s, a], single[s, b], total[s])
        for (s, a, b), n in both.items()
        if n >= least and n * total[s] >= lift * single[s, a] * single[s, b]
    }


@pytest.mark.parametrize("block", [3, 1024])
def test_equals_brute_force(spark, block):
    rng = random.Random(8)
    rows = []
    for c in range(260):
        scope = rng.choice(["s", "s", "t", None])
        group = rng.randrange(12)
        files = {f"f{group}_{k}" for k in range(rng.randrange(5))} | {rng.choice(["é", "Z", "a", "log"]) for _ in range(2)}
        rows += [(scope, f"c{c}", f, "clash") for f in files for _ in range(rng.choice([1, 1, 2]))]
    rows += [("s", None, "a", ""), ("s", "c1", None, "")]
    df = spark.createDataFrame(rows, "scope string, sha string, path string, no string").repartition(5)
    got = frequent_pairs(df, "scope", "sha", "path", 5, 4.0, block).collect()
    assert {tuple(r)[:7] for r in got} == brute(rows, 5, 4.0) and len(got) > 20
    assert all(math.isfinite(r.log_odds) and r.lift >= 4 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "scope string, sha string, path string")
    assert frequent_pairs(df, "scope", "sha", "path").count() == 0
