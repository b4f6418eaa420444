"""Work on keys of which a few hold most rows.

`heavy_keys` finds them from a sample, `split_join` and `count_distinct_by`
process them apart from the rest and unite both results. The sample only
decides where a row is processed, never whether it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.01, fraction: float = 1.0, seed: int = 7) -> list:
    """Keys that hold at least `share` of the rows of a sample of `fraction`.

    At most 1 / share keys reach the driver, whatever the size of the data.
    Null keys are left out. An empty table has none.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    sample = (df.sample(fraction, seed) if fraction < 1 else df).where(F.col(key).isNotNull())
    counts = sample.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.orderBy(F.desc("__n"), F.asc(key)).limit(int(1 / share) + 1).collect()
    if not top:
        return []
    total = sample.count()
    return [r[0] for r in top if r[1] >= share * total]


def hashed(key: str) -> Column:
    """What a key of any type is known by where it is only decided which way it goes."""
    return F.xxhash64(key)


def is_heavy(col: Column, keys: list) -> Column:
    """Membership in a bounded list of keys; null counts as light."""
    return F.coalesce(col.isin(keys), F.lit(False)) if keys else F.lit(False)


def split_join(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "left_anti", condition=None) -> DataFrame:
    """Join of `left` with `right`, which has one row per key at most.

    Rows of heavy keys meet a broadcast of the right rows of those keys (no
    more rows than `heavy` has keys, but for equal hashes); all others go
    through an ordinary shuffle. `heavy` holds the 64-bit hashes of the keys
    (`hashed`), so that keys of several columns are split alike.
    `condition(left, right)` adds a predicate beside the equality. A null key
    matches nothing.
    """

    def one(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed(key, "__key")
        on = a[key] == b["__key"]
        if condition is not None:
            on = on & condition(a, b)
        return a.join(b, on, how).drop("__key")

    if not heavy:
        return one(left, right)
    mine = is_heavy(hashed(key), heavy)
    hot = one(left.where(mine), F.broadcast(right.where(mine)))
    return hot.unionByName(one(left.where(~mine), right.where(~mine)))


def count_distinct_by(df: DataFrame, key: str, item: str, heavy: list) -> DataFrame:
    """(key, n): the number of distinct items of every key, in even working time.

    Rows of light keys are shuffled once, by key, and counted where they lie.
    Rows of heavy keys meet the broadcast list of heavy keys, which numbers
    them; they are spread by their item, so that equal items meet and the
    parts' counts can be added. Rows with a null key or item are left out; an
    empty table gives no rows.
    """
    rows = df.select(F.col(key), F.col(item)).where(F.col(key).isNotNull() & F.col(item).isNotNull())
    light = (
        rows.where(~is_heavy(F.col(key), heavy))
        .repartition(key)
        .groupBy(key, item)
        .agg(F.lit(1).alias("__one"))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not heavy:
        return light
    numbered = df.sparkSession.createDataFrame(
        [(k, i) for i, k in enumerate(heavy)], f"`{key}` {dict(rows.dtypes)[key]}, __no int"
    )
    counted = (
        rows.join(F.broadcast(numbered), key)
        .groupBy("__no", item)
        .agg(F.lit(1).alias("__one"))
        .groupBy("__no")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(numbered), "__no")
        .select(key, "n")
    )
    return light.unionByName(counted)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union of frames with the same columns."""
    return reduce(DataFrame.unionByName, parts)
