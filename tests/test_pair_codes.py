import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataspark.functions.pair_codes import blocks, count_pairs, run_lengths

MEMBERS = "__b1 bigint, __b2 bigint, no bigint"


def test_runs_are_summed_across_batches():
    parts = [[(1, 2), (1, 1)], [], [(1, 4)], [(2, 1), (3, 1), (3, 5)], [(3, 1)]]
    batches = [pa.RecordBatch.from_arrays([pa.array([c for c, _ in p], pa.int64()), pa.array([n for _, n in p], pa.int64())], ["code", "n"]) for p in parts]
    out = [r for b in run_lengths(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert out == [(1, 7), (2, 1), (3, 7)]
    assert np.all(np.diff([c for c, _ in out]) > 0)


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_counts_equal_brute_force(spark, block):
    rng = random.Random(block)
    baskets = {b: rng.sample(range(60), k) for b, k in enumerate([60, 41, 7, 8, 1, *[rng.randrange(1, 12) for _ in range(40)]])}
    df = spark.createDataFrame([(b, 0, i) for b, items in baskets.items() for i in items], MEMBERS).repartition(5)
    want = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2))
    assert {(r.no_a, r.no_b): r.n_ab for r in count_pairs(df, block).collect()} == want
    assert count_pairs(df.limit(0), block).count() == 0


def test_a_wide_basket_is_spread(spark):
    df = spark.range(100_000).selectExpr("7L AS __b1", "7L AS __b2", "id AS no")
    rows = blocks(df).selectExpr("size(left) AS l", "size(right) AS r", "spark_partition_id() AS p").collect()
    parts = -(-100_000 // 1024)
    assert len(rows) == parts * (parts + 1) // 2 and max(max(r.l, r.r) for r in rows) < 1300
    assert sum(r.l * r.r if r.r > 0 else r.l * (r.l - 1) // 2 for r in rows) == 100_000 * 99_999 // 2
    assert max(Counter(r.p for r in rows).values()) < 0.5 * len(rows)
