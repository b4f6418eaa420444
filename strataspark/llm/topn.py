"""The first N items of every group, in one fixed order.

Rows are spread over parts by the hash of their item, those of every group
alike, so that a group that holds a third of all rows fills no single task.
Every part has a local N-th best row of the group; at least N rows of the group
are as good, so it is a lower bound of the group's first N, and the best of the
bounds of all parts is one too. It is joined to the group's rows; rows worse
than it are dropped, and only the survivors are ranked. A group of fewer than N
items in every part has no bound, and all its rows are survivors.

Bounds hold for rows of which the newest version is known: an older row of an
item may lie in another file and be better than its newest one. Hence versions
are resolved first, in the parts, and bounds are not taken from files. As rows
meet by group and part once, that and the local order need no second shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of every group for each partition of a shuffle.
PARTS = 2


def newest(df: DataFrame, group: str, item: str, score: str, version: str, parts: int) -> DataFrame:
    """(__g, __part, __i, __s): of each item of a group the row of the newest version, of equal versions the highest score.

    Rows without a score are dropped first, so that a null in the newest row
    lets the one before count. A null version is older than any other. __g is
    the group in a struct, which makes a null group equal to itself. The frame
    is left distributed by group and part.
    """
    rows = df.where(F.col(score).isNotNull()).select(
        F.struct(F.col(group).alias("g")).alias("__g"), F.col(item).alias("__i"), F.col(score).alias("__s"), F.col(version).alias("__v"),
        F.pmod(F.xxhash64(item), F.lit(parts)).alias("__part"),
    )
    last = (
        rows.repartition("__g", "__part")
        .groupBy("__g", "__part", "__i")
        .agg(F.max(F.struct("__v", "__s")).alias("__m"))
    )
    return last.select("__g", "__part", "__i", F.col("__m.__s").alias("__s"))


def local_best(rows: DataFrame, n: int) -> DataFrame:
    """The rows with `__r`, their rank in their part of the group; those beyond the part's own bound, its n-th best row, are gone."""
    order = Window.partitionBy("__g", "__part").orderBy(F.desc("__s"), F.asc("__i"))
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n)


def bounds(local: DataFrame, n: int) -> DataFrame:
    """(__g, __bs, __bi): the best of the n-th best rows of a group's parts; groups without a part of n rows have none."""
    best_first = F.struct((-F.col("__s")).alias("s"), F.col("__i").isNotNull().alias("t"), F.col("__i").alias("i"))
    # no filter, as it would be pushed below the shuffle, which could then not be shared with the rows the bounds are joined to
    nth = local.groupBy("__g").agg(F.min_by(F.struct("__s", "__i"), F.when(F.col("__r") == n, best_first)).alias("b"))
    return nth.where(F.col("b").isNotNull()).select("__g", F.col("b.__s").alias("__bs"), F.col("b.__i").alias("__bi"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, version: str, parts: int | None = None) -> DataFrame:
    """(group, item, score, rank): the first n items of every group by score descending, then item ascending by bytes.

    Smaller groups give all their items. Rows with a null group form a group,
    rows with a null item an item that comes first among equal scores; an
    empty table gives no rows. Other columns of `df` are ignored. `parts`
    (default: twice the partitions of a shuffle) decides only where rows are
    ranked.
    """
    if n < 1:
        raise ValueError("n must be positive")
    parts = parts or PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # at most n rows of a group and part go on, so a group takes no more than n * parts rows to the task that ranks it
    local = local_best(newest(df, group, item, score, version, parts), n).repartition("__g")
    near = local.join(bounds(local, n), "__g", "left")
    kept = near.where(
        F.col("__bs").isNull()
        | (F.col("__s") > F.col("__bs"))
        | ((F.col("__s") == F.col("__bs")) & (F.col("__i").isNull() | F.col("__bi").isNotNull() & (F.col("__i") <= F.col("__bi"))))
    )
    # __r decides nothing here; it keeps both readers of the shuffle alike
    rank = F.row_number().over(Window.partitionBy("__g").orderBy(F.desc("__s"), F.asc("__i"), "__r"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= n)
    return ranked.select(F.col("__g.g").alias(group), F.col("__i").alias(item), F.col("__s").alias(score), "rank")
