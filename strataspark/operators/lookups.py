"""Lookups and projections of entities and relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.plans.registry import register
from strataspark.sources.graph import EDGE, ENT, REL, edges, relations
from strataspark.sources.tables import current_entities

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

# --- operators ---------------------------------------------------------------


def by_name(entities: DataFrame, name: str) -> DataFrame:
    """Entities of exactly this name; several may have it."""
    return entities.where(F.col("name") == name)


def by_type(entities: DataFrame, kind: str) -> DataFrame:
    """Entities of a type; abstract_class also means classes that are abstract."""
    if kind == "abstract_class":
        return entities.where((F.col("entity_type") == kind) | (F.col("entity_type") == "class") & F.col("is_abstract"))
    return entities.where(F.col("entity_type") == kind)


def has_attribute(key: str, value: str | None = None) -> Column:
    """Whether an attribute is there, or has exactly this value; an entity without attributes has none."""
    if value is None:
        return F.coalesce(F.map_contains_key("attributes", key), F.lit(False))
    return F.coalesce(F.element_at("attributes", F.lit(key)) == value, F.lit(False))


def by_attributes(entities: DataFrame, wanted: dict[str, str | None], kind: str | None = None) -> DataFrame:
    """Entities with all of the attributes, and of a type if one is given."""
    found = entities if kind is None else by_type(entities, kind)
    return found.where(reduce(lambda a, b: a & b, [has_attribute(k, v) for k, v in wanted.items()], F.lit(True)))


def narrow(entities: DataFrame, scope: str) -> DataFrame:
    """An entity as an output scope shows it: package (no more than id, name, type, file), class (no members) or method (all)."""
    if scope == "package":
        return entities.select("key", "name", "entity_type", F.col("source_location.file").alias("file"))
    if scope == "class":
        return entities.drop("members")
    if scope == "method":
        return entities
    raise ValueError(f"unknown output scope: {scope}")


def count_members(*kinds: str) -> Column:
    """The number of members of these types; none where the list is null."""
    some = F.filter("members", lambda m: m["type"].isin(*kinds))
    return F.coalesce(F.when(F.col("members").isNotNull(), F.size(some)), F.lit(0))


def for_scope(rels: DataFrame, scope: str) -> DataFrame:
    """Relations as an output scope shows them.

    package: no calls. class: a call becomes one dependency of its two ends,
    unless they have one already. method: all.
    """
    if scope == "method":
        return rels
    rest = rels.where(F.col("rel_type") != "call")
    if scope == "package":
        return rest
    known = rest.where(F.col("rel_type") == "dependency").select("source", "target").distinct()
    calls = rels.where(F.col("rel_type") == "call").select("source", "target").distinct()
    extra = calls.join(known, ["source", "target"], "left_anti").withColumn("rel_type", F.lit("dependency"))
    return rest.select("source", "target", "rel_type").unionByName(extra)


#: Targets that name no entity of a project (fixed values).
EXTERNAL = [
    "^(string|number|boolean|void|null|undefined|any|unknown|never|object|symbol|bigint)$",
    r"^(nodejs\.|buffer$|error$|promise$|map$|set$|array$|record$|weakmap|weakset)",
    r"^\{",
    r"^\[",
    r"^\d+$",
]


def without_external(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations without those to built-in types; a target that is an entity stays, whatever it is called."""
    built_in = reduce(lambda a, b: a | b, [F.col("target").rlike(p) for p in EXTERNAL])
    ids = entities.select(F.col("key").alias("target"))
    return rels.where(~built_in).unionByName(rels.where(built_in).join(ids, "target", "left_semi"))


def under(entities: DataFrame, rels: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The part of a graph under a file path: its entities, their outgoing relations, and the ends of these outside."""
    mine = entities.where(F.startswith(F.col("source_location.file"), F.lit(prefix)))
    ids = mine.select("key")
    out = rels.join(ids.withColumnRenamed("key", "source"), "source", "left_semi")
    ends = out.select(F.col("target").alias("key")).distinct().join(ids, "key", "left_anti")
    return mine, out, entities.join(ends, "key", "left_semi")


# --- queries -----------------------------------------------------------------

PREFIX = FILE = "src/core/"
_SHOWN = "key, name, entity_type"
#: Columns of entities that the lookups filter by or show.
SHOWN = ("name", "entity_type", "source_location", "is_abstract")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("key", "name", "entity_type")


@query(f"WITH {ENT} SELECT {_SHOWN} FROM ent WHERE name = 'FlowLoader0'")
def find_entity(spark: SparkSession, d: str) -> DataFrame:
    return _shown(by_name(current_entities(spark, d, *SHOWN), "FlowLoader0"))


@query(f"WITH {ENT} SELECT {_SHOWN} FROM ent WHERE entity_type = 'abstract_class' OR (entity_type = 'class' AND is_abstract)")
def find_abstract_classes(spark: SparkSession, d: str) -> DataFrame:
    return _shown(by_type(current_entities(spark, d, *SHOWN), "abstract_class"))


@query(f"WITH {ENT} SELECT {_SHOWN} FROM ent WHERE entity_type = 'interface'")
def find_interfaces(spark: SparkSession, d: str) -> DataFrame:
    return _shown(by_type(current_entities(spark, d, *SHOWN), "interface"))


@query(f"WITH {ENT} SELECT {_SHOWN} FROM ent WHERE list_contains(map_keys(attributes), 'deprecated')")
def find_with_attribute(spark: SparkSession, d: str) -> DataFrame:
    return _shown(by_attributes(current_entities(spark, d, *SHOWN, "attributes"), {"deprecated": None}))


@query(f"WITH {ENT} SELECT {_SHOWN} FROM ent WHERE list_contains(map_keys(attributes), 'team') AND attributes['exported'] = 'core' AND entity_type = 'class'")
def find_by_type_and_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _shown(by_attributes(current_entities(spark, d, *SHOWN, "attributes"), {"team": None, "exported": "core"}, "class"))


@query(f"WITH {ENT} SELECT {_SHOWN}, source_location.file AS file FROM ent WHERE source_location.file LIKE 'src/core/%'")
def find_in_files(spark: SparkSession, d: str) -> DataFrame:
    e = current_entities(spark, d, *SHOWN).where(F.startswith(F.col("source_location.file"), F.lit(FILE)))
    return narrow(e, "package")


@query(f"WITH {ENT} SELECT {_SHOWN} FROM ent WHERE key = 'commonlib.core.sessionplanner3'")
def find_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _shown(current_entities(spark, d, *SHOWN).where(F.col("key") == "commonlib.core.sessionplanner3"))


@query(f"""WITH {ENT} SELECT key, coalesce(len(list_filter(members, lambda m: m.type IN ('method', 'constructor'))), 0) AS methods,
    coalesce(len(list_filter(members, lambda m: m.type IN ('property', 'field'))), 0) AS fields, coalesce(source_location.file, 'unknown') AS file FROM ent""")
def entity_summaries(spark: SparkSession, d: str) -> DataFrame:
    return current_entities(spark, d).select(
        "key", count_members("method", "constructor").cast("bigint").alias("methods"),
        count_members("property", "field").cast("bigint").alias("fields"),
        F.coalesce("source_location.file", F.lit("unknown")).alias("file"),
    )


@query(f"""WITH {ENT}, m AS (SELECT key, unnest(members) AS m FROM ent) SELECT key, m.name AS method, coalesce(m.return_type, 'void') AS return_type,
    coalesce(len(m.parameters), 0) AS parameters FROM m WHERE m.type = 'method'""")
def method_list(spark: SparkSession, d: str) -> DataFrame:
    m = current_entities(spark, d, "members").select("key", F.explode("members").alias("m")).where(F.col("m.type") == "method")
    return m.select(
        "key", F.col("m.name").alias("method"), F.coalesce("m.return_type", F.lit("void")).alias("return_type"),
        F.coalesce(F.when(F.col("m.parameters").isNotNull(), F.size("m.parameters")), F.lit(0)).cast("bigint").alias("parameters"),
    )


@query(f"WITH {ENT} SELECT key, coalesce(len(list_filter(members, lambda m: m.visibility IS NULL OR m.visibility = 'public')), 0) AS public_members FROM ent")
def class_level_members(spark: SparkSession, d: str) -> DataFrame:
    """Members a class shows at class level: public ones and those without a visibility."""
    shown = F.filter("members", lambda m: m["visibility"].isNull() | (m["visibility"] == "public"))
    size = F.coalesce(F.when(F.col("members").isNotNull(), F.size(shown)), F.lit(0))
    return current_entities(spark, d, "members").select("key", size.cast("bigint").alias("public_members"))


@query(f"""WITH {REL}, rest AS (SELECT source, target, rel_type FROM rel WHERE rel_type <> 'call') SELECT * FROM rest
    UNION ALL SELECT DISTINCT source, target, 'dependency' FROM rel r WHERE rel_type = 'call' AND NOT EXISTS
      (SELECT 1 FROM rest x WHERE x.source = r.source AND x.target = r.target AND x.rel_type = 'dependency')""")
def class_scope_relations(spark: SparkSession, d: str) -> DataFrame:
    return for_scope(relations(spark, d), "class")


@query(f"WITH {REL} SELECT id, source, target, rel_type FROM rel WHERE rel_type <> 'call'")
def package_scope_relations(spark: SparkSession, d: str) -> DataFrame:
    return for_scope(relations(spark, d, "rel_type"), "package").select("id", "source", "target", "rel_type")


_EXT = " OR ".join(f"regexp_matches(target, '{p}')" for p in EXTERNAL)


@query(f"WITH {ENT}, {REL} SELECT id, source, target FROM rel WHERE NOT ({_EXT}) OR target IN (SELECT key FROM ent)")
def project_relations(spark: SparkSession, d: str) -> DataFrame:
    return without_external(relations(spark, d, "rel_type"), current_entities(spark, d, "id")).select("id", "source", "target")


@query(f"""WITH {REL} SELECT id, source, target FROM rel WHERE NOT (starts_with(source, 'experiments/') OR contains(source, '/experiments/')
    OR starts_with(target, 'experiments/') OR contains(target, '/experiments/'))""")
def relations_outside_experiments(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.startswith(F.col(c), F.lit("experiments/")) | F.contains(F.col(c), F.lit("/experiments/"))
    return relations(spark, d, "rel_type").where(~at("source") & ~at("target")).select("id", "source", "target")


_SUB = f"""WITH {ENT}, {REL}, mine AS (SELECT key FROM ent WHERE starts_with(source_location.file, '{PREFIX}')),
    o AS (SELECT * FROM rel WHERE source IN (SELECT key FROM mine))"""


@query(_SUB + """ SELECT key, 'entity' AS part FROM mine UNION ALL SELECT id, 'relation' FROM o
    UNION ALL SELECT DISTINCT key, 'stub' FROM ent WHERE key IN (SELECT target FROM o) AND key NOT IN (SELECT key FROM mine)""")
def submodule(spark: SparkSession, d: str) -> DataFrame:
    """The graph under one directory: entities, outgoing relations, stubs of what these reach outside."""
    mine, out, stubs = under(current_entities(spark, d), relations(spark, d), PREFIX)
    part = lambda df, c, p: df.select(F.col(c).alias("key"), F.lit(p).alias("part"))
    return part(mine, "key", "entity").unionByName(part(out, "id", "relation")).unionByName(part(stubs, "key", "stub"))


@query(f"WITH {EDGE} SELECT DISTINCT src AS key, dst AS supertype, rel_type FROM edge WHERE rel_type IN ('implementation', 'inheritance')")
def subtypes(spark: SparkSession, d: str) -> DataFrame:
    """Implementers and subclasses of every entity."""
    e = edges(spark, d, "rel_type").where(F.col("rel_type").isin("implementation", "inheritance"))
    return e.select(F.col("src").alias("key"), F.col("dst").alias("supertype"), "rel_type").distinct()


@query(f"""WITH {EDGE} SELECT DISTINCT src AS key FROM edge JOIN ent ON ent.key = dst WHERE rel_type = 'implementation' AND name = 'SessionPlanner3'""")
def find_implementers(spark: SparkSession, d: str) -> DataFrame:
    named = by_name(current_entities(spark, d, "name"), "SessionPlanner3").select(F.col("key").alias("dst"))
    e = edges(spark, d, "rel_type").where(F.col("rel_type") == "implementation")
    return e.join(named, "dst", "left_semi").select(F.col("src").alias("key")).distinct()


@query(f"WITH {EDGE} SELECT id, src, dst, rel_type FROM edge")
def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, "rel_type").select("id", "src", "dst", "rel_type")


@query(f"""WITH {REL}, e AS (SELECT DISTINCT source, target, rel_type FROM rel) SELECT rel_type, count(*) AS n FROM e GROUP BY 1""")
def distinct_relations_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Relations once per type and ends, counted by type."""
    return relations(spark, d, "rel_type").dropDuplicates(["rel_type", "source", "target"]).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ENT} SELECT key, 'missing name' AS issue FROM ent WHERE coalesce(name, '') = '' UNION ALL
    SELECT key, 'missing type' FROM ent WHERE coalesce(entity_type, '') = '' UNION ALL
    SELECT key, 'missing file' FROM ent WHERE coalesce(source_location.file, '') = ''""")
def model_issues(spark: SparkSession, d: str) -> DataFrame:
    """Entities without a name, type or file."""
    e = current_entities(spark, d)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issues = F.array_compact(
        F.array(
            F.when(empty("name"), F.lit("missing name")),
            F.when(empty("entity_type"), F.lit("missing type")),
            F.when(empty("source_location.file"), F.lit("missing file")),
        )
    )
    return e.select("key", F.explode(issues).alias("issue"))
