"""Counting pairs of items that lie in the same basket, whatever a basket's width.

Items get a number of 31 bits, a pair becomes one 64-bit code. Each task makes
the codes of its baskets in runs, sorts a run, and counts equal neighbours; the
shorter runs are sorted again by the shuffle's external sort (spilled sorted
runs, merged) and counted to the end. No pair of texts is ever shuffled.

A basket wider than a block is split by hash, and every two of its parts meet
in a row of their own that is shuffled by both parts' numbers: no task gets the
basket whole, neither when it is split nor when its parts are paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.plans.storage import cut

#: Items of a basket that one task pairs with each other or with as many others; wider baskets are split into blocks.
BLOCK = 1024
#: Codes of a run before it is sorted and counted.
RUN = 1 << 20
#: Wide baskets up to this number are broadcast (24 bytes each); more are joined by a shuffle.
WIDE = 100_000
#: Bytes of numbered items up to which they are broadcast; more are joined by a shuffle.
NEAR = 32 << 20
#: What stands for a basket and its scope: two 64-bit hashes. Among 10**10 baskets, that two are taken for one has a chance of 10**-19.
BASKET = ["__b1", "__b2"]


def hashed(scope: str, basket: str) -> list[Column]:
    return [F.xxhash64(scope, basket).alias(BASKET[0]), F.xxhash64(basket, F.lit(1), scope).alias(BASKET[1])]


def numbered(items: DataFrame) -> DataFrame:
    """Items with a number below 2**31 in column `no`.

    Partitions are written to the shared checkpoint folder first, so that later
    reads see the same numbers; only their sizes go to the driver.
    """
    made = F.monotonically_increasing_id()
    kept = cut(items.withColumns({"__p": F.shiftright(made, 33), "__r": made.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted((r[0], r[1]) for r in kept.groupBy("__p").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    if total >= 1 << 31:
        raise ValueError(f"{total} frequent items: their pairs do not fit into 64 bits")
    offsets = items.sparkSession.createDataFrame(starts, "__p bigint, __o bigint")
    return kept.join(F.broadcast(offsets), "__p").withColumn("no", F.col("__o") + F.col("__r")).drop("__p", "__o", "__r")


def near(items: DataFrame, *texts: str) -> DataFrame:
    """Numbered items as a broadcast, if with their texts they have NEAR bytes at most; that is counted first."""
    width = F.lit(48)
    for t in texts:
        width = width + F.octet_length(t)
    size = items.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(items) if size <= NEAR else items


def pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted runs of pair codes of the baskets' blocks of items."""
    run, size = [], 0

    def counted() -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(run), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])

    for b in batches:
        left, right = b.column(0), b.column(1)
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv, rv = left.values.to_numpy(zero_copy_only=False), right.values.to_numpy(zero_copy_only=False)
        for i in range(b.num_rows):
            x, y = np.sort(lv[lo[i] : lo[i + 1]]), np.sort(rv[ro[i] : ro[i + 1]])
            if len(y):
                codes = ((np.minimum.outer(x, y) << 32) | np.maximum.outer(x, y)).ravel()
            else:
                a, c = np.triu_indices(len(x), 1)
                codes = (x[a] << 32) | x[c]
            if len(codes):
                run.append(codes)
                size += len(codes)
            if size >= RUN:
                yield counted()
                run, size = [], 0
    if run:
        yield counted()


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal neighbours of sorted codes; the last code of a batch is carried into the next."""
    last, carried = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        codes, counts = b.column(0).to_numpy(), b.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        codes, counts = codes[starts], np.add.reduceat(counts, starts)
        if last is not None:
            if codes[0] == last:
                counts[0] += carried
            else:
                codes, counts = np.concatenate([[last], codes]), np.concatenate([[carried], counts])
        last, carried = codes[-1], counts[-1]
        yield pa.RecordBatch.from_arrays([pa.array(codes[:-1], pa.int64()), pa.array(counts[:-1], pa.int64())], ["code", "n_ab"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([carried], pa.int64())], ["code", "n_ab"])


def blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(left, right): the numbers of every basket to be paired; an empty `right` stands for the pairs within `left`."""
    none = F.array().cast("array<bigint>")
    lists = lambda rows: rows.groupBy(*BASKET).agg(F.collect_list("no").alias("left")).select("left", none.alias("right"))
    wide = members.groupBy(*BASKET).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block)
    if wide.isEmpty():
        return lists(members)
    wide = cut(wide.withColumn("parts", F.ceil(F.col("k") / block)))
    if wide.count() <= WIDE:
        wide = F.broadcast(wide)
    narrow = lists(members.join(wide, BASKET, "left_anti"))
    split = members.join(wide, BASKET).withColumn("p", F.pmod(F.xxhash64("no"), F.col("parts")))
    parts = split.groupBy(*BASKET, "parts", "p").agg(F.collect_list("no").alias("nos"))
    # every part goes to the rows of all its pairs, at most `parts` of them
    rows = parts.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")
    nos_of = lambda end: F.max(F.when(F.col("p") == F.col(end), F.col("nos")))
    both = rows.select(*BASKET, lo, hi, "p", "nos").groupBy(*BASKET, "lo", "hi").agg(nos_of("lo").alias("left"), nos_of("hi").alias("right"))
    met = both.where(F.col("left").isNotNull() & F.col("right").isNotNull())
    return narrow.unionByName(met.select("left", F.when(F.col("lo") == F.col("hi"), none).otherwise(F.col("right")).alias("right")))


def count_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(no_a, no_b, n_ab): the number of baskets that hold both items, no_a < no_b, of members (*BASKET, no) without repetition."""
    runs = blocks(members, block).mapInArrow(pair_runs, "code bigint, n bigint")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(run_lengths, "code bigint, n_ab bigint")
    return merged.select(F.shiftright("code", 32).alias("no_a"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("no_b"), "n_ab")
