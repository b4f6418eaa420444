"""The queries of the core's data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import plain
from strataspark.operators import flatten
from strataspark.operators.layers import TREE
from strataspark.operators.orphans import orphans
from strataspark.operators.skew import count_distinct_by, heavy_keys, union_all
from strataspark.plans.parallel import spread
from strataspark.sources.tables import all_entities, table

#: Share of all distinct pairs from which a target is heavy (fixed by the task).
HEAVY_SHARE = 0.01
PLAIN = r"lower(trim({}, ' ' || chr(9)))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relations").select(plain("target").alias("entity_id"), plain("source").alias("dependent"))
    return r.where((F.col("entity_id") != "") & (F.col("dependent") != ""))


def _in_degree(pairs: DataFrame) -> DataFrame:
    heavy = heavy_keys(pairs.select("entity_id"), "entity_id", HEAVY_SHARE / 2, fraction=0.1)
    return count_distinct_by(pairs, "entity_id", "dependent", heavy).withColumnRenamed("n", "dependents")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets with at least 1 % of all distinct (source, target) pairs."""
    n = _in_degree(_pairs(spark, d))
    total = n.agg(F.sum("dependents").alias("total"))
    return n.where(F.col("dependents") >= HEAVY_SHARE * total.scalar()).select("entity_id")


def p2_in_degree(spark: SparkSession, d: str) -> DataFrame:
    """Distinct dependents of every target of relations."""
    return _in_degree(_pairs(spark, d))


def p2_index_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Distinct dependents of every entity of the index, over all its scopes and builds."""
    a = table(spark, d, "arch_index").select(plain("entity_id").alias("entity_id"), F.explode("dependents").alias("x"))
    a = a.select("entity_id", plain("x").alias("dependent")).where((F.col("entity_id") != "") & (F.col("dependent") != ""))
    return _in_degree(a)


def p2_snapshot_gap(spark: SparkSession, d: str) -> DataFrame:
    """Per scope, the largest in-degree its latest snapshot recorded beside the one counted from its relations."""
    r = table(spark, d, "relations").select(
        "scope_key", plain("target").alias("entity_id"), plain("source").alias("dependent")
    )
    r = r.where((F.col("entity_id") != "") & (F.col("dependent") != "") & F.col("scope_key").isNotNull())
    now = (
        r.groupBy("scope_key", "entity_id", "dependent")
        .agg(F.lit(1).alias("one"))
        .groupBy("scope_key", "entity_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("scope_key")
        .agg(F.max("n").alias("counted"))
    )
    s = table(spark, d, "snapshots").where(F.col("max_in_degree").isNotNull() & F.col("taken_at").isNotNull())
    last = s.groupBy("scope_key").agg(
        F.max_by("max_in_degree", F.struct("taken_at", "max_in_degree")).alias("recorded")
    )
    return last.join(now, "scope_key").select("scope_key", "recorded", "counted")


def _references(spark: SparkSession, d: str, sample: float | None = None) -> DataFrame:
    """(src_table, record_id, ref_field, missing_id, t): all non-empty references, or those of a sample of the records."""

    def rows(name: str) -> DataFrame:
        t = table(spark, d, name)
        return t if sample is None else t.sample(sample, 11)

    def shape(df: DataFrame, src: str, key: str, field: str, ref: str, t: str) -> DataFrame:
        return df.select(
            F.lit(src).alias("src_table"), F.col(key).cast("string").alias("record_id"), F.lit(field).alias("ref_field"),
            plain(ref).alias("missing_id"), F.col(t).alias("t"),
        )

    a = rows("arch_index")
    raw = flatten.targets(rows("raw_docs"), "captured_at")
    parts = [
        shape(rows("relations"), "relations", "id", "target", "target", "observed_at"),
        shape(a, "arch_index", "index_id", "entity_id", "entity_id", "built_at"),
        shape(a.select("index_id", "built_at", F.explode("dependents").alias("x")), "arch_index", "index_id", "dependents", "x", "built_at"),
        shape(raw, "raw_docs", "raw_id", "target_id", "target_id", "captured_at"),
    ]
    return union_all(parts).where(F.col("missing_id") != "")


def _missing(spark: SparkSession, d: str) -> DataFrame:
    e = all_entities(spark, d).select(plain("id").alias("key"), "first_seen_at", "removed_at")
    return orphans(
        _references(spark, d), e, [("missing_id", "key")], at="t", valid=("first_seen_at", "removed_at"),
        sample=_references(spark, d, 0.05),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References to entities that did not exist at the time of the record."""
    return _missing(spark, d).select("src_table", "record_id", "ref_field", "missing_id").distinct()


def p3_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orphan references per table, field and month of the record."""
    m = _missing(spark, d).withColumn("month", F.trunc("t", "month"))
    return (
        m.groupBy("src_table", "ref_field", "month", "record_id", "missing_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("src_table", "ref_field", "month")
        .agg(F.count(F.lit(1)).alias("references"))
    )


def p3_composite(spark: SparkSession, d: str) -> DataFrame:
    """Index entries whose (scope, entity) is no pair of any entity; a null scope is matched on the entity alone."""
    a = table(spark, d, "arch_index").select("index_id", F.nullif("scope_key", F.lit("")).alias("scope"), F.nullif(plain("entity_id"), F.lit("")).alias("entity"))
    e = all_entities(spark, d).select(F.col("scope_key").alias("e_scope"), plain("id").alias("e_id"))
    return orphans(a, e, [("scope", "e_scope"), ("entity", "e_id")], "partial").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per object nested in the payloads."""
    return flatten.found(spread(table(spark, d, "raw_docs").select("raw_id", "payload"))).distinct()


def _flat(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return flatten.flat(spread(table(spark, d, "raw_docs").select("raw_id", "payload")), kind).distinct()

    query.__doc__ = f"The flat table of kind {kind}."
    return query


QUERIES = {
    "p2_found": p2_found,
    "p2_in_degree": p2_in_degree,
    "p2_index_dependents": p2_index_dependents,
    "p2_snapshot_gap": p2_snapshot_gap,
    "p3_found": p3_found,
    "p3_monthly": p3_monthly,
    "p3_composite": p3_composite,
    "p4_found": p4_found,
} | {f"p4_flat_{k}": _flat(k) for k in flatten.KINDS}

_T, _S = PLAIN.format("target"), PLAIN.format("source")
_PAIRS = f"SELECT DISTINCT {_T} AS entity_id, {_S} AS dependent FROM relations WHERE {_T} <> '' AND {_S} <> ''"
_IDX = f"SELECT DISTINCT {PLAIN.format('entity_id')} AS entity_id, {PLAIN.format('x')} AS dependent FROM (SELECT entity_id, unnest(dependents) AS x FROM arch_index)"

SQL = {
    "p2_found": f"WITH p AS ({_PAIRS}) SELECT entity_id FROM p GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT count(*) FROM p)",
    "p2_in_degree": f"SELECT entity_id, count(*) AS dependents FROM ({_PAIRS}) GROUP BY 1",
    "p2_index_dependents": f"SELECT entity_id, count(*) AS dependents FROM ({_IDX}) WHERE entity_id <> '' AND dependent <> '' GROUP BY 1",
    "p2_snapshot_gap": f"""
        WITH p AS (SELECT DISTINCT scope_key, {_T} AS t, {_S} AS s FROM relations
                   WHERE {_T} <> '' AND {_S} <> '' AND scope_key IS NOT NULL),
             c AS (SELECT scope_key, max(n) AS counted FROM (SELECT scope_key, t, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1),
             s AS (SELECT scope_key, max_in_degree AS recorded, row_number() OVER
                          (PARTITION BY scope_key ORDER BY taken_at DESC, max_in_degree DESC) AS rn
                   FROM snapshots WHERE max_in_degree IS NOT NULL AND taken_at IS NOT NULL)
        SELECT s.scope_key, recorded, counted FROM s JOIN c USING (scope_key) WHERE rn = 1""",
    "p3_composite": f"""
        WITH e AS (SELECT scope_key, {PLAIN.format('id')} AS id FROM entities UNION SELECT scope_key, {PLAIN.format('id')} FROM shared_entities),
             a AS (SELECT DISTINCT index_id, nullif(scope_key, '') AS scope, nullif({PLAIN.format('entity_id')}, '') AS entity FROM arch_index)
        SELECT index_id, scope, entity FROM a WHERE (scope IS NOT NULL OR entity IS NOT NULL) AND NOT EXISTS
          (SELECT 1 FROM e WHERE (a.scope IS NULL OR e.scope_key = a.scope) AND (a.entity IS NULL OR e.id = a.entity)
             AND NOT (a.scope IS NOT NULL AND e.scope_key IS NULL) AND NOT (a.entity IS NOT NULL AND e.id IS NULL))""",
}

_MISSING = f"""WITH {TREE}, life AS (SELECT {PLAIN.format('id')} AS k, first_seen_at AS f, removed_at AS r FROM entities UNION SELECT {PLAIN.format('id')}, first_seen_at, removed_at FROM shared_entities),
    refs AS (SELECT 'relations' AS src_table, id AS record_id, 'target' AS ref_field, {_T} AS missing_id, observed_at AS t FROM relations
      UNION ALL SELECT 'arch_index', index_id, 'entity_id', {PLAIN.format('entity_id')}, built_at FROM arch_index
      UNION ALL SELECT 'arch_index', index_id, 'dependents', {PLAIN.format('x')}, built_at FROM (SELECT index_id, built_at, unnest(dependents) AS x FROM arch_index)
      UNION ALL SELECT 'raw_docs', raw_id::VARCHAR, 'target_id', {PLAIN.format("json_extract_string(n, '$.targetId')")}, captured_at
        FROM outgoing JOIN (SELECT DISTINCT raw_id, captured_at FROM raw_docs) USING (raw_id)),
    missing AS (SELECT DISTINCT src_table, record_id, ref_field, missing_id, t FROM refs WHERE missing_id <> '' AND NOT EXISTS
      (SELECT 1 FROM life WHERE k = missing_id AND f <= t AND (r IS NULL OR r > t)))"""
SQL["p3_found"] = _MISSING + " SELECT DISTINCT src_table, record_id, ref_field, missing_id FROM missing"
SQL["p3_monthly"] = _MISSING + """ SELECT src_table, ref_field, date_trunc('month', t)::DATE AS month, count(*) AS "references" FROM
    (SELECT DISTINCT src_table, ref_field, date_trunc('month', t) AS t, record_id, missing_id FROM missing) GROUP BY 1, 2, 3"""
SQL["p4_found"] = f"WITH {TREE} " + " UNION ".join(f"SELECT raw_id, '{k}' AS kind, path FROM {k}" for k in flatten.KINDS)
for _k in flatten.KINDS:
    _above = "parent_path" if _k in flatten.CHILDREN else "NULL::VARCHAR AS parent_path"
    _fields = ", ".join(f"json_extract_string(n, '$.{f}')::{flatten.SQL_TYPES.get(f, 'varchar')} AS \"{c}\"" for c, f in flatten.COLUMNS[_k].items())
    SQL[f"p4_flat_{_k}"] = f"WITH {TREE} SELECT DISTINCT raw_id, path, {_above}, {_fields} FROM {_k}"
