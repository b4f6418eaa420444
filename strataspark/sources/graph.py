"""The code graph as DataFrames: entities, relations, resolved edges; and the same as SQL views for comparison.

Ids are compared plain. Redelivered relations count once (the newest arrival),
several relations between the same two entities stay several edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import plain
from strataspark.sources.tables import current_entities, table


#: What a relation says beside its ends and type.
DETAILS = ("confidence", "inference_source", "source_method", "target_method", "call_type", "scope_key")


def relations(spark: SparkSession, root: str, *details: str) -> DataFrame:
    """One row per relation id with rel_type, source, target and details, ends plain and not empty. Name the details that are needed (default: all): no others are read or shuffled, and `rel_type` stands for none."""
    r = table(spark, root, "relations").withColumns({"source": plain("source"), "target": plain("target")})
    r = r.where((F.col("source") != "") & (F.col("target") != "") & F.col("id").isNotNull())
    more = [c for c in details or DETAILS if c != "rel_type"]
    newest = F.max(F.struct("ingested_at", "observed_at", "rel_type", "source", "target", *more)).alias("r")
    return r.groupBy("id").agg(newest).select("id", *(f"r.{c}" for c in ("rel_type", "source", "target", *more)))


def resolver(entities: DataFrame) -> DataFrame:
    """(end, key): what an end of a relation stands for: an id itself, else a name that exactly one entity has."""
    ids = entities.select(F.col("key").alias("end"), "key")
    names = (
        entities.where(F.col("name").isNotNull())
        .groupBy(F.lower("name").alias("end"))
        .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == 1)
        .drop("n")
    )
    return ids.unionByName(names.join(ids, "end", "left_anti"))


def edges(spark: SparkSession, root: str, *details: str) -> DataFrame:
    """Relations whose ends both resolve, as (id, src, dst, rel_type, details as of `relations`). Targets are uneven: adaptive execution splits the join."""
    ends = resolver(current_entities(spark, root, "name"))
    r = relations(spark, root, *details)
    a = ends.select(F.col("end").alias("source"), F.col("key").alias("src"))
    b = ends.select(F.col("end").alias("target"), F.col("key").alias("dst"))
    return r.join(a, "source").join(b, "target").drop("source", "target")


PLAIN = "lower(trim({}, ' ' || chr(9)))"
#: Views of the same meaning. Every view names those it needs before it.
ENT = f"""ent AS (SELECT * EXCLUDE (rn) FROM (
  SELECT {PLAIN.format('id')} AS key, *, row_number() OVER (PARTITION BY {PLAIN.format('id')} ORDER BY first_seen_at DESC NULLS LAST,
    id DESC, name DESC NULLS LAST, entity_type DESC NULLS LAST, source_location.file DESC NULLS LAST) AS rn
  FROM (SELECT * FROM entities UNION ALL BY NAME SELECT * FROM shared_entities) WHERE removed_at IS NULL AND id IS NOT NULL) WHERE rn = 1)"""
REL = f"""rel AS (SELECT * EXCLUDE (rn) FROM (
  SELECT * EXCLUDE (source, target), {PLAIN.format('source')} AS source, {PLAIN.format('target')} AS target, row_number() OVER (PARTITION BY id
    ORDER BY ingested_at DESC NULLS LAST, observed_at DESC NULLS LAST, rel_type DESC NULLS LAST, {PLAIN.format('source')} DESC, {PLAIN.format('target')} DESC) AS rn
  FROM relations WHERE {PLAIN.format('source')} <> '' AND {PLAIN.format('target')} <> '' AND id IS NOT NULL) WHERE rn = 1)"""
EDGE = f"""{ENT}, {REL},
  nm AS (SELECT lower(name) AS n, min(key) AS key FROM ent WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
  ends AS (SELECT key AS endpoint, key FROM ent UNION ALL SELECT n, key FROM nm WHERE n NOT IN (SELECT key FROM ent)),
  edge AS (SELECT rel.id, rel_type, confidence, inference_source, source_method, target_method, call_type, rel.scope_key, a.key AS src, b.key AS dst
    FROM rel JOIN ends a ON a.endpoint = rel.source JOIN ends b ON b.endpoint = rel.target)"""
