"""Items that appear together much more often than chance.

Pairs are packed into 64-bit codes, sorted in runs, merged by the shuffle's
external sort and counted by run lengths (`functions/pair_codes.py`); odds
ratios with a continuity correction follow from the counts.

Before that, items that cannot be in any case are left out, which loses
nothing: with n(a,b) >= s, both items are in s baskets at least; with
n(a,b) * N >= l * n(a) * n(b) and n(a,b) <= min(n(a), n(b)), neither item is in
more than N / l baskets. So the item that is nearly everywhere makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.pair_codes import BASKET, BLOCK, count_pairs, hashed, near, numbered
from strataspark.plans.storage import cut


def frequent_pairs(
    df: DataFrame, scope: str, basket: str, item: str, min_count: int = 5, min_lift: float = 4.0, block: int = BLOCK
) -> DataFrame:
    """Pairs of items of a scope with their counts: (scope, item_a, item_b, n_ab, n_a, n_b, n_all, lift, log_odds).

    A case has n_ab >= min_count and n_ab * n_all >= min_lift * n_a * n_b, all
    being numbers of distinct baskets of the scope; item_a < item_b by bytes.
    log_odds is the logarithm of the odds ratio of both items with 0.5 added to
    each of the four counts, so that it is finite also where a count is zero.

    Rows with a null scope, basket or item are left out, repeated rows count
    once, an empty table gives no rows, other columns are ignored.
    """
    rows = df.select(F.col(scope).alias("__s"), F.col(basket).alias("__b"), F.col(item).alias("__i")).dropna()
    once = cut(rows.select("__s", *hashed("__s", "__b"), "__i").distinct())
    totals = once.groupBy("__s", *BASKET).agg(F.lit(1).alias("one")).groupBy("__s").agg(F.count(F.lit(1)).alias("n_all"))
    counts = once.groupBy("__s", "__i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    items = counts.join(totals, "__s").where(F.col("n") * F.lit(min_lift) <= F.col("n_all"))
    items = near(numbered(items.select("__s", "__i", "n", "n_all")), "__s", "__i")

    members = cut(once.join(items.select("__s", "__i", "no"), ["__s", "__i"]).select(*BASKET, "no"))
    pairs = count_pairs(members, block).where(F.col("n_ab") >= min_count)
    a = items.select(F.col("no").alias("no_a"), F.col("__s").alias("sa"), F.col("__i").alias("ia"), F.col("n").alias("na"), "n_all")
    c = items.select(F.col("no").alias("no_b"), F.col("__i").alias("ib"), F.col("n").alias("nb"))
    named = pairs.join(a, "no_a").join(c, "no_b")
    named = named.where(F.col("n_ab") * F.col("n_all") >= F.lit(min_lift) * F.col("na") * F.col("nb"))
    swap = F.col("ia") > F.col("ib")
    both, only_a, only_b = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    none = F.col("n_all") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    return named.select(
        F.col("sa").alias(scope),
        F.when(swap, F.col("ib")).otherwise(F.col("ia")).alias("item_a"),
        F.when(swap, F.col("ia")).otherwise(F.col("ib")).alias("item_b"),
        "n_ab",
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("n_a"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("n_b"),
        "n_all",
    ).withColumns(
        {
            "lift": both * F.col("n_all") / (F.col("n_a") * F.col("n_b")),
            "log_odds": F.log((both + 0.5) * (none + 0.5) / ((only_a + 0.5) * (only_b + 0.5))),
        }
    )
