"""References to records that do not exist, or did not at the time.

A reference can be composite and partly null. References are grouped by their
null mask; each group is anti-joined with the parents on its non-null columns
only. What a partly null reference means is declared:

* ``simple``: it is satisfied (SQL's default);
* ``partial``: its non-null columns must be found together in one parent;
* ``full``: it is an orphan, whatever the parents hold.

A reference of nulls only is no reference under any of them.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.operators.skew import hashed, heavy_keys, split_join, union_all


def _alive(spans: Column, at: Column) -> Column:
    """Whether a moment lies in one of the lifetimes [since, until); an open end never ends, a null start never began."""
    return F.coalesce(F.exists(spans, lambda s: (s["since"] <= at) & (s["until"].isNull() | (s["until"] > at))), F.lit(False))


def lifetimes(parents: DataFrame, keys: list[str], since: str | None, until: str | None) -> DataFrame:
    """(__key, spans): one row per key, with its distinct lifetimes. Keys with a null column are left out."""
    span = F.struct(F.col(since).alias("since"), F.col(until).alias("until")) if since else F.lit(None)
    return (
        parents.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
        .groupBy(_packed(keys).alias("__key"))
        .agg(F.collect_set(span).alias("spans") if since else F.lit(1).alias("spans"))
    )


def _packed(keys: list[str]) -> Column:
    """The key columns as one: the column itself, or a struct of them."""
    return F.col(keys[0]) if len(keys) == 1 else F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def orphans(
    refs: DataFrame,
    parents: DataFrame,
    on: list[tuple[str, str]],
    match: str = "partial",
    at: str | None = None,
    valid: tuple[str, str] | None = None,
    sample: DataFrame | None = None,
    share: float = 0.005,
) -> DataFrame:
    """The rows of `refs` whose key has no parent, with the columns of `refs`.

    `on` pairs a column of the references with one of the parents. With `at`
    and `valid` a parent counts only in its lifetime [valid[0], valid[1]); a
    reference with a null time has no parent. `sample` is a sample of the
    references (default: 1 in 20 of those of a mask): keys with at least `share` of it are
    joined by broadcast, so that a key that holds a third of all references
    costs no single task. Repeated references stay repeated; empty parents make
    all references orphans, empty references none.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    if (at is None) != (valid is None):
        raise ValueError("at and valid go together")
    out = []
    for mask in product((True, False), repeat=len(on)):
        if not any(mask):
            continue
        kept = [pair for pair, there in zip(on, mask) if there]
        has_mask = [F.col(r).isNotNull() if there else F.col(r).isNull() for (r, _), there in zip(on, mask)]
        group = refs
        for c in has_mask:
            group = group.where(c)
        if not all(mask):
            if match == "simple":
                continue
            if match == "full":
                out.append(group)
                continue
        keys = [r for r, _ in kept]
        life = lifetimes(parents, [p for _, p in kept], *(valid or (None, None)))
        keyed = group.withColumn("__key", _packed(keys))
        alive = (lambda a, b: _alive(b["spans"], a[at])) if at else None
        part = group.sample(0.05, 7) if sample is None else sample
        heavy = heavy_keys(part.select(_packed(keys).alias("__key")).select(hashed("__key").alias("__h")), "__h", share)
        out.append(split_join(keyed, life, "__key", heavy, "left_anti", alive).drop("__key"))
    return union_all(out)


def report(found: DataFrame, table: str, at: str) -> DataFrame:
    """(src_table, month, references): the number of orphan references per table and month; a null time gives a null month."""
    return found.groupBy(F.col(table).alias("src_table"), F.date_trunc("month", F.col(at)).alias("month")).agg(
        F.count(F.lit(1)).alias("references")
    )
