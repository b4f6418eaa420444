"""Rollups of the code graph: files, packages, scopes, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.functions.text import dirname, dotted_package, glob_to_regex, plain
from strataspark.operators import coverage
from strataspark.operators.coverage import tests_sql
from strataspark.operators.graph import CLOSURE as _CLOSURE
from strataspark.operators.graph import components, degrees
from strataspark.operators.layers import TREE, layer
from strataspark.operators.lookups import count_members
from strataspark.plans.registry import register
from strataspark.sources.graph import EDGE, ENT, PLAIN, edges, relations
from strataspark.sources.tables import current_entities, table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

# --- operators ---------------------------------------------------------------


def counted(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, c, before): every different value of a group, how often it occurs, and how many values are smaller.

    Equal values are counted first, so that what is sorted of a group is its different values only.
    """
    c = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("before", running - F.col("c"))


def gini(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, gini): inequality of the values of every group, 0 where there are none or all are 0. Null values are left out."""
    c = counted(values, keys, value)
    n, total = F.sum("c"), F.sum(F.col("c") * F.col(value))
    ranks = F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2  # of equal values together
    g = 2 * F.sum(ranks * F.col(value)) / (n * total) - (n + 1) / n
    return c.groupBy(*keys).agg(F.when(total == 0, 0.0).otherwise(g).alias("gini"))


def file_stats(entities: DataFrame, es: DataFrame) -> DataFrame:
    """Per scope and file: lines (the largest end line), entities, methods, fields, and sums of its entities' degrees."""
    d = entities.where(F.col("source_location.file").isNotNull()).join(degrees(es), "key", "left")
    return d.groupBy("scope_key", F.col("source_location.file").alias("file")).agg(
        F.coalesce(F.max("source_location.end_line"), F.lit(0)).alias("loc"),
        F.count(F.lit(1)).alias("entities"),
        F.sum(count_members("method", "constructor")).alias("methods"),
        F.sum(count_members("property", "field")).alias("fields"),
        F.sum(F.coalesce("in_degree", F.lit(0))).alias("in_degree"),
        F.sum(F.coalesce("out_degree", F.lit(0))).alias("out_degree"),
    )


def file_cycles(entities: DataFrame, members: DataFrame) -> DataFrame:
    """(scope_key, file, cycles): how many cycles touch a file; files without any are left out. `members` has (key, component)."""
    f = entities.where(F.col("source_location.file").isNotNull()).select("key", "scope_key", F.col("source_location.file").alias("file"))
    return f.join(members, "key").groupBy("scope_key", "file").agg(F.countDistinct("component").alias("cycles"))


#: What tells a test's file from others, by the file's extension (fixed values).
TEST_FILES = {
    r"\.(?:ts|tsx|js|jsx)$": r"\.(?:test|spec)\.(?:ts|tsx|js|jsx)$",
    r"\.kts?$": r"Tests?\.kt$|[\\/](?:test|androidTest|sharedTest)[\\/]",
    r"\.java$": r"(?:Test|Tests|TestCase)\.java$|[\\/]test[\\/]",
    r"\.py$": r"(?:^|[\\/])test_[^\\/]+\.py$|_test\.py$",
    r"\.(?:cpp|cc|cxx)$": r"(?i)\.(?:test|spec)\.(?:cpp|cc|cxx)$|(?:[\\/]|^)test[_-]",
}


def test_file(file: Column) -> Column:
    """Whether a file is a test's by the convention of its language; of other languages, by .test. or .spec. in its name."""
    out = file.rlike(r"\.(?:test|spec)\.")
    for ext, pattern in TEST_FILES.items():
        out = F.when(file.rlike(ext), file.rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def package_stats(files: DataFrame, depth: int = 2) -> DataFrame:
    """Packages by directories of a depth of 1 to 5: files, those of tests, entities, methods, fields, lines."""
    p = F.array_join(F.slice(F.split(dirname(F.col("file")), "/"), 1, max(1, min(5, depth))), "/")
    return files.groupBy("scope_key", p.alias("package")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(test_file(F.col("file"))).alias("test_files"), *(F.sum(c).alias(c) for c in ("entities", "methods", "fields", "loc"))
    )


def dotted_package_stats(entities: DataFrame) -> DataFrame:
    """Packages by the ids up to their last dot, `.` without one: the same figures; a file counts in every package that has an entity in it, with the lines of these."""
    at = F.col("source_location.file")
    p = F.when(F.col("key").rlike(r"^.+\.[^.]*$"), F.regexp_replace("key", r"\.[^.]*$", "")).otherwise(".")
    e = entities.select(
        "scope_key", p.alias("package"), at.alias("file"), F.col("source_location.end_line").alias("end_line"), count_members("method", "constructor").alias("methods"), count_members("property", "field").alias("fields")
    )
    each = e.groupBy("scope_key", "package", "file").agg(F.count(F.lit(1)).alias("entities"), F.sum("methods").alias("methods"), F.sum("fields").alias("fields"), F.coalesce(F.max("end_line"), F.lit(0)).alias("loc"))
    return each.groupBy("scope_key", "package").agg(
        F.count("file").alias("files"), F.count_if(test_file(F.col("file"))).alias("test_files"), *(F.sum(c).alias(c) for c in ("entities", "methods", "fields", "loc"))
    )


def node_package_stats(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Package nodes of a graph (scope_key, folder, ...) of the kinds internal and cmd, with the entities, methods and fields of the files in their folders and below; 0 where there are none."""
    own = nodes.where(F.col("node_type").isin("internal", "cmd"))
    parts = F.split("file", "/")
    # a file is counted for every folder above it, and for itself, by an equi join
    above = files.select("scope_key", "entities", "methods", "fields", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("folder"))
    sums = above.groupBy("scope_key", "folder").agg(*(F.sum(c).alias(c) for c in ("entities", "methods", "fields")))
    return own.join(sums, ["scope_key", "folder"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("entities", "methods", "fields")})


#: Kinds of entities that the figures of a module tell apart (fixed values).
KINDS = {"class": "classes", "interface": "interfaces", "function": "functions", "enum": "enums"}


def module_stats(entities: DataFrame) -> DataFrame:
    """Modules, which are directories: files, those of tests, entities, methods, fields, and entities of each of KINDS."""
    file = F.col("source_location.file")
    e = entities.where(file.isNotNull())
    return e.groupBy("scope_key", dirname(file).alias("module")).agg(
        F.countDistinct(file).alias("files"), F.countDistinct(F.when(test_file(file), file)).alias("test_files"), F.count(F.lit(1)).alias("entities"),
        F.sum(count_members("method", "constructor")).alias("methods"), F.sum(count_members("property", "field")).alias("fields"),
        *(F.count_if(F.col("entity_type") == kind).alias(name) for kind, name in KINDS.items()),
    )


def metric_vector(files: DataFrame, packages: DataFrame, rels: DataFrame, members: DataFrame, covered: DataFrame) -> DataFrame:
    """The eleven metrics of every scope, under the names of METRICS.

    `rels` has (scope_key, inference_source), `members` (scope_key, component)
    of cycles, `covered` (scope_key, score) of all entities. A scope has a row
    if it has a file; what it has none of counts 0, a coverage without entities
    is null.
    """
    f = files.groupBy("scope_key").agg(F.sum("entities").alias("total_entities"), F.max("in_degree").alias("max_in_degree"), F.max("out_degree").alias("max_out_degree"))
    p = packages.groupBy("scope_key").agg(F.max("files").alias("max_package_size"), F.count(F.lit(1)).alias("package_count"))
    inferred = F.col("inference_source").isNotNull() & (F.col("inference_source") != "explicit")
    r = rels.groupBy("scope_key").agg(F.count(F.lit(1)).alias("total_relations"), F.round(F.avg(F.when(inferred, 1.0).otherwise(0.0)), 6).alias("inferred_relation_ratio"))
    c = members.groupBy("scope_key").agg(F.countDistinct("component").alias("scc_count"))
    v = covered.groupBy("scope_key").agg(F.round(F.avg(F.when(F.col("score") > 0, 1.0).otherwise(0.0)), 6).alias("entity_coverage_ratio"))
    gi = gini(files, ["scope_key"], "in_degree").select("scope_key", F.round("gini", 6).alias("gini_in_degree"))
    gp = gini(packages, ["scope_key"], "files").select("scope_key", F.round("gini", 6).alias("gini_package_size"))
    out = f.join(p, "scope_key").join(gi, "scope_key", "left").join(gp, "scope_key", "left").join(r, "scope_key", "left").join(c, "scope_key", "left").join(v, "scope_key", "left")
    return out.select("scope_key", *(F.col(m) if m == "entity_coverage_ratio" else F.coalesce(m, F.lit(0)).alias(m) for m in METRICS))


def snapshot(vectors: DataFrame, commit: str, branch: str, at: str) -> DataFrame:
    """The snapshot of a run: the vectors of all scopes under a commit, a branch and a time, with the columns of the table of snapshots."""
    stamp = {"commit_sha": F.lit(commit), "branch": F.lit(branch), "taken_at": F.lit(at).cast("timestamp_ntz")}
    return vectors.withColumns(stamp).select("scope_key", *stamp, *METRICS)


def package_dependencies(entities: DataFrame, es: DataFrame) -> DataFrame:
    """(scope_key, source, target, rel_type, n): edges between different packages (two dot segments of the id)."""
    p = lambda c: dotted_package(F.col(c), 2)
    e = es.select(p("src").alias("source"), p("dst").alias("target"), "rel_type")
    return e.where((F.col("source") != F.col("target"))).groupBy("source", "target", "rel_type").agg(F.count(F.lit(1)).alias("n"))


def fan(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, fan_in, fan_out) of every node from (source, target) rows; nodes without edges have 0."""
    i = pairs.groupBy(F.col("target").alias("key")).agg(F.count(F.lit(1)).alias("fan_in"))
    o = pairs.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(i, "key", "left").join(o, "key", "left").select("key", zero("fan_in"), zero("fan_out"))


#: Metrics of a snapshot; ratios and counts that are compared between snapshots (fixed names).
METRICS = [
    "total_entities", "total_relations", "inferred_relation_ratio", "scc_count", "max_in_degree", "max_out_degree",
    "max_package_size", "gini_in_degree", "gini_package_size", "package_count", "entity_coverage_ratio",
]
#: Metrics whose growth is expansion, and the change in per cent below which a metric is neutral (fixed values).
EXPANDING, THRESHOLD = ("total_entities", "total_relations", "package_count", "scc_count", "gini_in_degree"), 5.0


def newest(snapshots: DataFrame, n: int = 2) -> DataFrame:
    """The n newest snapshots of every scope with their rank; redeliveries count once, rows without a time or scope not at all."""
    s = snapshots.where(F.col("taken_at").isNotNull() & F.col("scope_key").isNotNull())
    s = s.groupBy("scope_key", "commit_sha", "taken_at").agg(*(F.max(m).alias(m) for m in METRICS))
    order = Window.partitionBy("scope_key").orderBy(F.desc("taken_at"), "commit_sha")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def unpivot(s: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, value): the metrics of snapshots as rows; missing values stay null."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    return s.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.metric", "x.value")


def diff(snapshots: DataFrame) -> DataFrame:
    """(scope_key, metric, from_value, to_value, delta, percent_change) of the two newest snapshots; no percentage from 0 or from null."""
    two = newest(snapshots, 2)
    to = unpivot(two.where(F.col("rank") == 1), "scope_key").withColumnRenamed("value", "to_value")
    old = unpivot(two.where(F.col("rank") == 2), "scope_key").withColumnRenamed("value", "from_value")
    delta = F.col("to_value") - F.col("from_value")
    return to.join(old, ["scope_key", "metric"]).withColumns(
        {"delta": delta, "percent_change": F.when(F.col("from_value") != 0, delta / F.col("from_value") * 100)}
    )


def directions(snapshots: DataFrame) -> DataFrame:
    """(scope_key, direction, confidence, expanding, contracting): the majority of five signals between the two newest snapshots of a scope.

    Cycles count at any change, the rest from 5 %; without a majority a scope
    is stable. Confidence is medium from three snapshots on, else low; a scope
    of one snapshot has insufficient_data, no confidence and no signals.
    """
    seen = newest(snapshots, 3)
    scopes = seen.groupBy("scope_key").agg(F.max("rank").alias("seen"))
    c = diff(snapshots).where(F.col("metric").isin(*EXPANDING))
    moved = F.when(F.col("metric") == "scc_count", F.col("delta") != 0).otherwise(F.abs("percent_change") >= THRESHOLD)
    up = F.coalesce(moved & (F.col("delta") > 0), F.lit(False))
    down = F.coalesce(moved & (F.col("delta") < 0), F.lit(False))
    votes = c.groupBy("scope_key").agg(F.count_if(up).alias("expanding"), F.count_if(down).alias("contracting"))
    half = len(EXPANDING) / 2
    told = F.when(F.col("seen") < 2, "insufficient_data").when(F.col("expanding") > half, "expansion").when(F.col("contracting") > half, "contraction").otherwise("stable")
    return scopes.join(votes, "scope_key", "left").select(
        "scope_key", told.alias("direction"), F.when(F.col("seen") >= 3, "medium").when(F.col("seen") == 2, "low").alias("confidence"),
        *(F.coalesce(v, F.lit(0)).alias(v) for v in ("expanding", "contracting")),
    )


#: Change of a series between its two newest values from which it rises or decreases (fixed value).
TREND = 0.002


def trend(series: DataFrame, keys: list[str], at: str, value: str, tie: str) -> DataFrame:
    """(keys, trend): rising, decreasing or stable by the two newest values of every series; stable if there are fewer, or one is null.

    For series of structural health the value is the normalized intrinsic dimension.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(at), tie)
    two = series.where(F.col(at).isNotNull()).select(*keys, F.col(value).alias("v"), F.row_number().over(w).alias("r")).where(F.col("r") <= 2)
    now, before = (F.max(F.when(F.col("r") == r, F.col("v"))) for r in (1, 2))
    change = now - before
    return two.groupBy(*keys).agg(F.when(change > TREND, "rising").when(change < -TREND, "decreasing").otherwise("stable").alias("trend"))


def compare(op: str, a: Column, b: Column) -> Column:
    """The comparison of a fitness rule."""
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]


def metric_rules(values: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(scope_key, metric, op, threshold, value, passed) for rules (metric, op, threshold); a missing value fails."""
    out = None
    for metric, op, threshold in rules:
        part = values.where(F.col("metric") == metric).select(
            "scope_key", "metric", F.lit(op).alias("op"), F.lit(float(threshold)).alias("threshold"), "value",
            F.coalesce(compare(op, F.col("value"), F.lit(float(threshold))), F.lit(False)).alias("passed"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def forbidden(rels: DataFrame, source: str, target: str) -> DataFrame:
    """Relations from what one glob matches to what another does: violations of a rule that there be none."""
    return rels.where(F.col("source").rlike(glob_to_regex(source)) & F.col("target").rlike(glob_to_regex(target)))


def losses() -> dict[str, tuple[Column, Column]]:
    """Loss -> (proxy value, status) of a snapshot row."""
    size = F.col("total_entities") + F.col("total_relations")
    status = lambda c, limit: F.when(c <= limit, "healthy").otherwise("warning")
    return {
        "feasibility": (F.col("scc_count"), status(F.col("scc_count"), 0)),
        "consistency": (F.col("inferred_relation_ratio"), status(F.col("inferred_relation_ratio"), 0.3)),
        "description-length": (size, F.lit("info")),
        "generation-alignment": (F.col("gini_in_degree"), status(F.col("gini_in_degree"), 0.5)),
    }


def tiers(edges_: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the weight of their strength: 5 from the 85th percentile, 3 above the median, else 1; 1 for all where all are equal.

    Percentiles are elements of the sorted list (index n * p), not interpolated.
    """
    c = counted(edges_, keys, "strength")
    n = c.groupBy(*keys).agg(F.sum("c").alias("__n"))
    at = lambda p: F.min(F.when(F.col("before") + F.col("c") > F.least(F.floor(F.col("__n") * p), F.col("__n") - 1), F.col("strength")))
    limits = c.join(n, keys).groupBy(*keys).agg(F.min("strength").alias("__min"), F.max("strength").alias("__max"), at(0.5).alias("__mid"), at(0.85).alias("__top"))
    flat = F.col("__mid") >= F.col("__max")
    mid, top = F.when(flat, F.col("__min")).otherwise(F.col("__mid")), F.when(flat, F.col("__max")).otherwise(F.col("__top"))
    weight = F.when(F.col("__min") == F.col("__max"), 1.0).when(F.col("strength") >= top, 5.0).when(F.col("strength") > mid, 3.0).otherwise(1.0)
    return edges_.join(limits, keys).withColumn("tier", weight).drop("__min", "__max", "__mid", "__top")


def longest_prefix(ids: DataFrame, prefixes: dict[str, str], column: str) -> DataFrame:
    """Rows with `layer`, the label of the longest prefix that is the id or a path above it; null where none is. Prefixes are few and declared."""
    layer = F.lit(None).cast("string")
    for prefix, label in sorted(prefixes.items(), key=lambda x: len(x[0])):
        layer = F.when((F.col(column) == prefix) | F.startswith(column, F.lit(prefix + "/")), label).otherwise(layer)
    return ids.withColumn("layer", layer)


# --- queries -----------------------------------------------------------------

_DEG = """deg AS (SELECT key, sum(i) AS in_degree, sum(o) AS out_degree FROM
      (SELECT dst AS key, 1 AS i, 0 AS o FROM edge UNION ALL SELECT src, 0, 1 FROM edge) GROUP BY 1)"""
FS = f"""{EDGE}, {_DEG}, fs AS (SELECT scope_key, source_location.file AS file, coalesce(max(source_location.end_line), 0) AS loc, count(*) AS entities,
    sum(coalesce(len(list_filter(members, lambda m: m.type IN ('method', 'constructor'))), 0))::BIGINT AS methods,
    sum(coalesce(len(list_filter(members, lambda m: m.type IN ('property', 'field'))), 0))::BIGINT AS fields,
    sum(coalesce(in_degree, 0))::BIGINT AS in_degree, sum(coalesce(out_degree, 0))::BIGINT AS out_degree
    FROM ent LEFT JOIN deg USING (key) WHERE source_location.file IS NOT NULL GROUP BY 1, 2)"""
_DIR = "CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END"
_sql_test = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, '{e}') THEN regexp_matches({c}, '{p}')" for e, p in reversed(TEST_FILES.items())) + f" ELSE coalesce(regexp_matches({c}, '\\.(?:test|spec)\\.'), false) END"
PS = f"""ps AS (SELECT scope_key, array_to_string(string_split({_DIR}, '/')[1:2], '/') AS package, count(*) AS files, count(*) FILTER (WHERE {_sql_test('file')}) AS test_files, sum(entities)::BIGINT AS entities,
    sum(methods)::BIGINT AS methods, sum(fields)::BIGINT AS fields, sum(loc)::BIGINT AS loc FROM fs GROUP BY 1, 2)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    return file_stats(current_entities(spark, d, "scope_key", "source_location", "members"), edges(spark, d, "rel_type"))


@query(f"WITH {FS} SELECT * FROM fs")
def rollup_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)


@query(f"WITH {FS}, {PS} SELECT * FROM ps")
def rollup_packages(spark: SparkSession, d: str) -> DataFrame:
    return package_stats(_files(spark, d))


@query(f"WITH {FS}, {PS} SELECT * FROM ps WHERE files >= 2 AND loc >= 100 ORDER BY loc DESC, scope_key, package LIMIT 20")
def rollup_packages_top(spark: SparkSession, d: str) -> DataFrame:
    """The 20 packages with most lines among those with at least 2 files and 100 lines."""
    p = package_stats(_files(spark, d)).where((F.col("files") >= 2) & (F.col("loc") >= 100))
    return p.orderBy(F.desc("loc"), "scope_key", "package").limit(20)


_GINI = "CASE WHEN sum({v}) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(r * {v}) / (count(*) * sum({v})) - (count(*) + 1.0::DOUBLE) / count(*) END"


_METHODS = "coalesce(len(list_filter(members, lambda m: m.type IN ('method', 'constructor'))), 0)"
_FIELDS = "coalesce(len(list_filter(members, lambda m: m.type IN ('property', 'field'))), 0)"


@query(f"""WITH {ENT}, e AS (SELECT scope_key, CASE WHEN regexp_matches(key, '^.+\\.[^.]*$') THEN regexp_replace(key, '\\.[^.]*$', '') ELSE '.' END AS package, source_location.file AS file, count(*) AS entities,
      sum({_METHODS}) AS methods, sum({_FIELDS}) AS fields, coalesce(max(source_location.end_line), 0) AS loc FROM ent GROUP BY 1, 2, 3)
    SELECT scope_key, package, count(file) AS files, count(*) FILTER (WHERE file IS NOT NULL AND {_sql_test('file')}) AS test_files, sum(entities)::BIGINT AS entities, sum(methods)::BIGINT AS methods,
      sum(fields)::BIGINT AS fields, sum(loc)::BIGINT AS loc FROM e GROUP BY 1, 2""")
def rollup_dotted_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages by the dots of the ids."""
    return dotted_package_stats(current_entities(spark, d, "scope_key", "source_location", "members"))


@query(f"""WITH {ENT} SELECT scope_key, {_DIR.replace('file', 'source_location.file')} AS module, count(DISTINCT source_location.file) AS files,
      count(DISTINCT CASE WHEN {_sql_test('source_location.file')} THEN source_location.file END) AS test_files, count(*) AS entities, sum({_METHODS})::BIGINT AS methods, sum({_FIELDS})::BIGINT AS fields,
      {', '.join(f"count(*) FILTER (WHERE entity_type = '{k}') AS {n}" for k, n in KINDS.items())} FROM ent WHERE source_location.file IS NOT NULL GROUP BY 1, 2""")
def rollup_modules(spark: SparkSession, d: str) -> DataFrame:
    """Directories as modules, with their entities by kind."""
    return module_stats(current_entities(spark, d, "scope_key", "source_location", "members", "entity_type"))


_GINI_OF = lambda of, v: f"SELECT scope_key, round({_GINI.format(v=v)}, 6) AS gini_{of} FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY {v}) AS r FROM {'fs' if of == 'in_degree' else 'ps'}) GROUP BY 1"


@query(f"""WITH RECURSIVE {FS}, {PS}, {_CLOSURE}, {tests_sql('ent', 'edge')}, gi AS ({_GINI_OF('in_degree', 'in_degree')}), gp AS ({_GINI_OF('package_size', 'files')}),
      r AS (SELECT scope_key, count(*) AS total_relations, round(avg(CASE WHEN inference_source IS NOT NULL AND inference_source <> 'explicit' THEN 1.0 ELSE 0.0 END), 6) AS inferred_relation_ratio FROM rel GROUP BY 1),
      c AS (SELECT scope_key, count(DISTINCT component) AS scc_count FROM cyc JOIN ent USING (key) GROUP BY 1),
      v AS (SELECT ent.scope_key, round(avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END), 6) AS entity_coverage_ratio FROM ent LEFT JOIN cov USING (key) GROUP BY 1)
    SELECT scope_key, total_entities, coalesce(total_relations, 0) AS total_relations, coalesce(inferred_relation_ratio, 0) AS inferred_relation_ratio, coalesce(scc_count, 0) AS scc_count, max_in_degree, max_out_degree,
      max_package_size, coalesce(gini_in_degree, 0) AS gini_in_degree, coalesce(gini_package_size, 0) AS gini_package_size, package_count, entity_coverage_ratio
    FROM (SELECT scope_key, sum(entities)::BIGINT AS total_entities, max(in_degree) AS max_in_degree, max(out_degree) AS max_out_degree FROM fs GROUP BY 1)
      JOIN (SELECT scope_key, max(files) AS max_package_size, count(*) AS package_count FROM ps GROUP BY 1) USING (scope_key)
      LEFT JOIN gi USING (scope_key) LEFT JOIN gp USING (scope_key) LEFT JOIN r USING (scope_key) LEFT JOIN c USING (scope_key) LEFT JOIN v USING (scope_key)""")
def metric_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The metric vector of every scope."""
    e, es = current_entities(spark, d, "scope_key", "source_location", "members"), edges(spark, d, "rel_type")
    f = file_stats(e, es).where(F.col("scope_key").isNotNull())
    own = e.select("key", "scope_key")
    covered = own.join(coverage.entity_scores(spark, d), "key", "left")
    return metric_vector(f, package_stats(f), relations(spark, d, "inference_source", "scope_key"), own.join(components(es), "key"), covered)


@query(f"""WITH RECURSIVE {EDGE}, {_CLOSURE} SELECT scope_key, source_location.file AS file, count(DISTINCT component) AS cycles FROM cyc JOIN ent USING (key) WHERE source_location.file IS NOT NULL GROUP BY 1, 2""")
def rollup_file_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles that touch a file."""
    return file_cycles(current_entities(spark, d, "scope_key", "source_location"), components(edges(spark, d, "rel_type")))


@query(f"""WITH {TREE}, {FS}, n AS (SELECT DISTINCT raw_id, path, json_extract_string(n, '$.id') AS id, json_extract_string(n, '$.type') AS node_type, json_extract_string(n, '$.fileCount')::BIGINT AS file_count FROM package_node),
      f AS (SELECT raw_id, path, id, node_type, file_count, string_split(id, '/')[1] AS scope_key, 'src/' || string_split(id, '/')[-1] AS folder FROM n WHERE node_type IN ('internal', 'cmd'))
    SELECT f.raw_id, f.path, f.id, f.node_type, f.file_count, f.scope_key, f.folder, coalesce(sum(entities), 0)::BIGINT AS entities, coalesce(sum(methods), 0)::BIGINT AS methods, coalesce(sum(fields), 0)::BIGINT AS fields
    FROM f LEFT JOIN fs ON fs.scope_key = f.scope_key AND (fs.file = folder OR starts_with(fs.file, folder || '/')) GROUP BY ALL""")
def rollup_node_packages(spark: SparkSession, d: str) -> DataFrame:
    """Package nodes of Go graphs with what the files of their scope's folder of the same name hold."""
    parts = F.split("id", "/")
    n = layer(spark, d, "package_node").select("raw_id", "path", "id", "node_type", "file_count", parts[0].alias("scope_key"), F.concat(F.lit("src/"), F.element_at(parts, -1)).alias("folder"))
    return node_package_stats(n, _files(spark, d).select("scope_key", "file", "entities", "methods", "fields"))


_DP = "array_to_string(list_filter(string_split({}, '.'), lambda x: x <> '')[1:2], '.')"
PD = f"""{EDGE}, pe AS (SELECT {_DP.format('src')} AS source, {_DP.format('dst')} AS target, rel_type FROM edge), pd AS (SELECT source, target, rel_type, count(*) AS n FROM pe WHERE source <> target GROUP BY 1, 2, 3)"""


@query(f"WITH {PD} SELECT * FROM pd")
def rollup_package_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return package_dependencies(current_entities(spark, d, "id"), edges(spark, d, "rel_type"))


@query(f"""WITH {PD}, nodes AS (SELECT DISTINCT {_DP.format('key')} AS key FROM ent), c AS (SELECT source, target FROM pe WHERE source <> target)
    SELECT key, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM nodes LEFT JOIN (SELECT target AS key, count(*) AS n FROM c GROUP BY 1) i USING (key)
    LEFT JOIN (SELECT source AS key, count(*) AS n FROM c GROUP BY 1) o USING (key)""")
def rollup_package_fan(spark: SparkSession, d: str) -> DataFrame:
    """Edges between packages, in and out, of every package."""
    p = lambda c: dotted_package(F.col(c), 2)
    pairs = edges(spark, d, "rel_type").select(p("src").alias("source"), p("dst").alias("target")).where(F.col("source") != F.col("target"))
    return fan(pairs, current_entities(spark, d, "id").select(p("key").alias("key")).distinct())


@query(f"""WITH {PD}, u AS (SELECT DISTINCT source, target FROM pd) SELECT target AS key, count(*) AS fan_in FROM u GROUP BY 1 ORDER BY fan_in DESC, key LIMIT 5""")
def influential_packages(spark: SparkSession, d: str) -> DataFrame:
    """The 5 packages most packages depend on."""
    u = package_dependencies(current_entities(spark, d, "id"), edges(spark, d, "rel_type")).select("source", "target").distinct()
    return u.groupBy(F.col("target").alias("key")).agg(F.count(F.lit(1)).alias("fan_in")).orderBy(F.desc("fan_in"), "key").limit(5)


@query(f"""WITH {EDGE}, anc AS (SELECT key, array_to_string(string_split(key, '.')[1:k], '.') AS prefix FROM (SELECT key, unnest(range(1, len(string_split(key, '.')))) AS k FROM ent))
    SELECT prefix AS package, count(*) AS entities FROM anc GROUP BY 1""")
def rollup_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Entities under every dotted prefix; nested packages count in all above."""
    parts = F.split("key", r"\.")
    e = current_entities(spark, d, "id").select("key", parts.alias("p")).where(F.size("p") > 1)
    e = e.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", 1, k), "."))).alias("package"))
    return e.groupBy("package").agg(F.count(F.lit(1)).alias("entities"))


@query(f"""WITH {PD}, g AS (SELECT source, target, sum(n)::BIGINT AS strength FROM pd GROUP BY 1, 2),
      r AS (SELECT *, split_part(source, '.', 1) AS scope FROM g),
      x AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY strength) AS rn, count(*) OVER (PARTITION BY scope) AS c, min(strength) OVER (PARTITION BY scope) AS lo, max(strength) OVER (PARTITION BY scope) AS hi FROM r),
      y AS (SELECT *, max(CASE WHEN rn = least(floor(c * 0.5::DOUBLE), c - 1) + 1 THEN strength END) OVER (PARTITION BY scope) AS mid0,
             max(CASE WHEN rn = least(floor(c * 0.85::DOUBLE), c - 1) + 1 THEN strength END) OVER (PARTITION BY scope) AS top0 FROM x),
      z AS (SELECT *, CASE WHEN mid0 >= hi THEN lo ELSE mid0 END AS mid, CASE WHEN mid0 >= hi THEN hi ELSE top0 END AS top FROM y)
    SELECT source, target, strength, CASE WHEN lo = hi THEN 1.0::DOUBLE WHEN strength >= top THEN 5.0 WHEN strength > mid THEN 3.0 ELSE 1.0 END AS tier FROM z""")
def package_edge_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Package dependencies with the tier of their strength within the scope."""
    g = package_dependencies(current_entities(spark, d, "id"), edges(spark, d, "rel_type")).groupBy("source", "target").agg(F.sum("n").alias("strength"))
    return tiers(g.withColumn("scope", F.substring_index("source", ".", 1)), ["scope"]).drop("scope")


_LAYERS = {"src": "source", "src/core": "kernel", "lib": "library", "src/api": "surface"}


@query(f"""WITH {ENT} SELECT key, CASE WHEN source_location.file LIKE 'src/core/%' THEN 'kernel' WHEN source_location.file LIKE 'src/api/%' THEN 'surface'
    WHEN source_location.file LIKE 'src/%' THEN 'source' WHEN source_location.file LIKE 'lib/%' THEN 'library' END AS layer FROM ent""")
def entity_layers(spark: SparkSession, d: str) -> DataFrame:
    """The layer of every entity by the longest prefix of its file."""
    e = current_entities(spark, d, "source_location").select("key", F.col("source_location.file").alias("file"))
    return longest_prefix(e, _LAYERS, "file").select("key", "layer")


_NEW = f"""sn AS (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY taken_at DESC, commit_sha NULLS FIRST) AS rank FROM
    (SELECT scope_key, commit_sha, taken_at, {', '.join(f'max({m}) AS {m}' for m in METRICS)} FROM snapshots WHERE taken_at IS NOT NULL AND scope_key IS NOT NULL GROUP BY 1, 2, 3)),
  lo AS ({' UNION ALL '.join(f"SELECT scope_key, rank, '{m}' AS metric, {m}::DOUBLE AS value FROM sn WHERE rank <= 2" for m in METRICS)}),
  di AS (SELECT a.scope_key, a.metric, b.value AS from_value, a.value AS to_value, a.value - b.value AS delta, CASE WHEN b.value <> 0 THEN (a.value - b.value) / b.value * 100 END AS percent_change
    FROM lo a JOIN lo b ON a.scope_key = b.scope_key AND a.metric = b.metric WHERE a.rank = 1 AND b.rank = 2)"""


@query(f"WITH {_NEW} SELECT scope_key, metric, from_value, to_value, round(delta, 6) AS delta, round(percent_change, 6) AS percent_change FROM di")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    x = diff(table(spark, d, "snapshots"))
    return x.withColumns({c: F.round(c, 6) for c in ("delta", "percent_change")})


_EXP = ", ".join(f"'{m}'" for m in EXPANDING)


@query(f"""WITH {_NEW}, v AS (SELECT scope_key, count(*) FILTER (WHERE m AND delta > 0) AS expanding, count(*) FILTER (WHERE m AND delta < 0) AS contracting FROM
      (SELECT *, CASE WHEN metric = 'scc_count' THEN delta <> 0 ELSE abs(percent_change) >= 5 END AS m FROM di WHERE metric IN ({_EXP})) GROUP BY 1)
    SELECT scope_key, CASE WHEN n < 2 THEN 'insufficient_data' WHEN expanding > 2.5 THEN 'expansion' WHEN contracting > 2.5 THEN 'contraction' ELSE 'stable' END AS direction,
      CASE WHEN n >= 3 THEN 'medium' WHEN n = 2 THEN 'low' END AS confidence, coalesce(expanding, 0) AS expanding, coalesce(contracting, 0) AS contracting
    FROM (SELECT scope_key, count(*) AS n FROM sn GROUP BY 1) LEFT JOIN v USING (scope_key)""")
def direction_hints(spark: SparkSession, d: str) -> DataFrame:
    """Whether every scope expands or contracts, by its two newest snapshots."""
    return directions(table(spark, d, "snapshots"))


_RULES = [("scc_count", "==", 0), ("inferred_relation_ratio", "<=", 0.3), ("gini_in_degree", "<", 0.5), ("max_package_size", "<=", 30), ("entity_coverage_ratio", ">=", 0.2)]


@query(f"WITH {_NEW}, v AS (SELECT * FROM lo WHERE rank = 1) " + " UNION ALL ".join(
    f"SELECT scope_key, metric, '{op}' AS op, {t}::DOUBLE AS threshold, value, coalesce(value {'=' if op == '==' else op} {t}::DOUBLE, false) AS passed FROM v WHERE metric = '{m}'" for m, op, t in _RULES))
def fitness_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metric rules on the newest snapshot of every scope."""
    return metric_rules(unpivot(newest(table(spark, d, "snapshots"), 1), "scope_key"), _RULES)


@query(f"WITH {EDGE} SELECT id, source, target FROM rel WHERE regexp_matches(source, '{glob_to_regex('*.core.*')}') AND regexp_matches(target, '{glob_to_regex('*.{{api,cli}}.*'.replace('{{', '{').replace('}}', '}'))}')")
def fitness_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Relations that break the rule: nothing of core may use api or cli."""
    return forbidden(relations(spark, d, "rel_type"), "*.core.*", "*.{api,cli}.*").select("id", "source", "target")


@query(f"""WITH {_NEW} SELECT scope_key, 'feasibility' AS loss, scc_count::DOUBLE AS value, CASE WHEN scc_count <= 0 THEN 'healthy' ELSE 'warning' END AS status FROM sn WHERE rank = 1
    UNION ALL SELECT scope_key, 'consistency', inferred_relation_ratio, CASE WHEN inferred_relation_ratio <= 0.3 THEN 'healthy' ELSE 'warning' END FROM sn WHERE rank = 1
    UNION ALL SELECT scope_key, 'description-length', total_entities + total_relations, 'info' FROM sn WHERE rank = 1
    UNION ALL SELECT scope_key, 'generation-alignment', gini_in_degree, CASE WHEN gini_in_degree <= 0.5 THEN 'healthy' ELSE 'warning' END FROM sn WHERE rank = 1""")
def loss_proxies(spark: SparkSession, d: str) -> DataFrame:
    """Loss proxies of the newest snapshot of every scope."""
    s = newest(table(spark, d, "snapshots"), 1)
    rows = F.array(*[F.struct(F.lit(n).alias("loss"), v.cast("double").alias("value"), st.alias("status")) for n, (v, st) in losses().items()])
    return s.select("scope_key", F.explode(rows).alias("x")).select("scope_key", "x.*")


@query(f"""WITH {_NEW}, l AS (SELECT scope_key, max(CASE WHEN rank = 1 THEN entity_coverage_ratio END) - max(CASE WHEN rank = 2 THEN entity_coverage_ratio END) AS change FROM sn GROUP BY 1)
    SELECT scope_key, CASE WHEN change > 0.002 THEN 'rising' WHEN change < -0.002 THEN 'decreasing' ELSE 'stable' END AS trend FROM l""")
def trends(spark: SparkSession, d: str) -> DataFrame:
    """Trend of a normalized figure of every scope; the data hold no series of intrinsic dimensions, so it is the share of covered entities."""
    s = newest(table(spark, d, "snapshots"), 2)
    return trend(s, ["scope_key"], "taken_at", "entity_coverage_ratio", "commit_sha")


@query(f"WITH {_NEW} SELECT scope_key, commit_sha, taken_at FROM sn WHERE rank <= 3")
def pruned_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What stays of the snapshots if every scope keeps its 3 newest."""
    return newest(table(spark, d, "snapshots"), 3).select("scope_key", "commit_sha", "taken_at")


@query(f"""WITH x AS (SELECT {PLAIN.format('entity_id')} AS key, file, row_number() OVER (PARTITION BY scope_key, {PLAIN.format('entity_id')} ORDER BY built_at DESC NULLS LAST, index_id DESC) AS rn, scope_key FROM arch_index
      WHERE {PLAIN.format('entity_id')} <> '') SELECT scope_key, key, file FROM x WHERE rn = 1""")
def index_files(spark: SparkSession, d: str) -> DataFrame:
    """The file of every indexed entity by the newest build of its scope."""
    a = table(spark, d, "arch_index").withColumn("key", plain("entity_id")).where(F.col("key") != "")
    return a.groupBy("scope_key", "key").agg(F.max_by("file", F.struct("built_at", "index_id")).alias("file"))


# --- trees, layers and series of packages --------------------------------------


def package_tree(packages: DataFrame, column: str = "package") -> DataFrame:
    """(package, parent, virtual): packages under their longest proper prefix in the tree; prefixes of at least two packages are in it too."""
    p = F.split(column, "/")
    real = packages.select(F.col(column).alias("package")).where(F.col(column) != "").distinct()
    up = lambda df, c: df.select("*", F.explode(F.when(F.size(F.split(c, "/")) > 1, F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/")) - 1), lambda k: F.array_join(F.slice(F.split(c, "/"), 1, k), "/")))).alias("prefix"))
    shared = up(real, "package").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select(F.col("prefix").alias("package"))
    nodes = real.withColumn("virtual", F.lit(False)).unionByName(shared.join(real, "package", "left_anti").withColumn("virtual", F.lit(True)))
    above = up(nodes.select("package"), "package").join(nodes.select(F.col("package").alias("prefix")), "prefix")
    parent = above.groupBy("package").agg(F.max_by("prefix", F.length("prefix")).alias("parent"))
    return nodes.join(parent, "package", "left").select("package", "parent", "virtual")


def connectivity(es: DataFrame, vertices: DataFrame) -> DataFrame:
    """(scope_key, vertices, edges, isolated, density): how connected the graph of every scope is; density of ordered pairs, 0 for a single vertex."""
    v = vertices.groupBy("scope_key").agg(F.count(F.lit(1)).alias("vertices"))
    e = es.where(F.col("src") != F.col("dst")).select("scope_key", "src", "dst").distinct().groupBy("scope_key").agg(F.count(F.lit(1)).alias("edges"))
    lone = vertices.join(degrees(es).select("key"), "key", "left_anti").groupBy("scope_key").agg(F.count(F.lit(1)).alias("isolated"))
    j = v.join(e, "scope_key", "left").join(lone, "scope_key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("edges", "isolated")})
    pairs = F.col("vertices") * (F.col("vertices") - 1)
    return j.withColumn("density", F.round(F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0), 6))


def package_trend(history: DataFrame, package: str) -> DataFrame:
    """(timestamp, fan_in, fan_out, cycles, entities) of one package, from rows (timestamp, packages ARRAY<STRUCT>); snapshots without it are left out."""
    x = history.select("timestamp", F.explode("packages").alias("p")).where(F.col("p.name") == package)
    return x.select("timestamp", F.col("p.fanIn").alias("fan_in"), F.col("p.fanOut").alias("fan_out"), F.col("p.cycleCount").alias("cycles"), F.col("p.entityCount").alias("entities"))


@query(f"""WITH {ENT}, r AS (SELECT DISTINCT regexp_replace(source_location.file, '/[^/]*$', '') AS package FROM ent WHERE contains(source_location.file, '/')),
      u AS (SELECT package, array_to_string(string_split(package, '/')[1:k], '/') AS prefix FROM (SELECT package, unnest(range(1, len(string_split(package, '/')))) AS k FROM r)),
      n AS (SELECT package, false AS virtual FROM r UNION ALL SELECT prefix, true FROM u WHERE prefix NOT IN (SELECT package FROM r) GROUP BY 1 HAVING count(*) >= 2),
      nu AS (SELECT package, array_to_string(string_split(package, '/')[1:k], '/') AS prefix FROM (SELECT package, unnest(range(1, len(string_split(package, '/')))) AS k FROM n))
    SELECT n.package, (SELECT arg_max(prefix, length(prefix)) FROM nu WHERE nu.package = n.package AND prefix IN (SELECT package FROM n)) AS parent, virtual FROM n""")
def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    """The directories of the entities as a tree."""
    f = current_entities(spark, d, "source_location").where(F.contains("source_location.file", F.lit("/"))).select(dirname(F.col("source_location.file")).alias("package"))
    return package_tree(f)


@query(f"""WITH {EDGE}, v AS (SELECT scope_key, count(*) AS vertices FROM ent GROUP BY 1), e AS (SELECT scope_key, count(*) AS edges FROM (SELECT DISTINCT scope_key, src, dst FROM edge WHERE src <> dst) GROUP BY 1),
      l AS (SELECT scope_key, count(*) AS isolated FROM ent WHERE key NOT IN (SELECT src FROM edge UNION SELECT dst FROM edge) GROUP BY 1)
    SELECT v.scope_key, vertices, coalesce(edges, 0) AS edges, coalesce(isolated, 0) AS isolated, round(CASE WHEN vertices > 1 THEN coalesce(edges, 0)::DOUBLE / (vertices * (vertices - 1)) ELSE 0 END, 6) AS density
    FROM v LEFT JOIN e USING (scope_key) LEFT JOIN l USING (scope_key)""")
def scope_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Vertices, edges, isolated vertices and density of every scope."""
    return connectivity(edges(spark, d, "scope_key"), current_entities(spark, d, "scope_key").select("key", "scope_key"))


@query(f"""WITH {EDGE}, l AS (SELECT key, CASE WHEN source_location.file LIKE 'src/core/%' THEN 'kernel' WHEN source_location.file LIKE 'src/api/%' THEN 'surface' WHEN source_location.file LIKE 'src/%' THEN 'source'
      WHEN source_location.file LIKE 'lib/%' THEN 'library' END AS layer FROM ent)
    SELECT a.layer AS source, b.layer AS target, count(*) AS n FROM edge JOIN l a ON a.key = src JOIN l b ON b.key = dst WHERE a.layer <> b.layer GROUP BY 1, 2""")
def layer_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Edges between different layers."""
    e = longest_prefix(current_entities(spark, d, "source_location").select("key", F.col("source_location.file").alias("file")), _LAYERS, "file").where(F.col("layer").isNotNull())
    a, b = e.select(F.col("key").alias("src"), F.col("layer").alias("source")), e.select(F.col("key").alias("dst"), F.col("layer").alias("target"))
    j = edges(spark, d, "rel_type").select("src", "dst").join(a, "src").join(b, "dst").where(F.col("source") != F.col("target"))
    return j.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
