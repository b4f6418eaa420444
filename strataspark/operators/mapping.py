"""Relations out of parsed tables: what parsers of several languages found, joined into inheritance, uses and calls.

The tables are those any parser can give: classes (id, package, name), what
they extend, their fields, parameters and call sites as rows. Every mapping is
a join or a semi-join; a relation is given once per type, source and target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.plans.registry import register
from strataspark.sources.graph import EDGE, ENT, edges
from strataspark.sources.tables import current_entities

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

#: Types of Java that no project declares: primitive ones, boxes and names of its library that stand without a package (fixed values).
JAVA_TYPES = (
    "void boolean byte char short int long float double Boolean Byte Character Short Integer Long Float Double String Object "
    "List Map Set Collection Queue Deque Iterator Iterable Optional Stream Future Callable Runnable Comparator Exception RuntimeException Error Throwable Thread Logger Class Enum Number Math "
    "StringBuilder StringBuffer ByteBuffer CharBuffer IntBuffer ShortBuffer LongBuffer FloatBuffer DoubleBuffer Path File URI URL InputStream OutputStream Reader Writer Closeable AutoCloseable "
    "Serializable Comparable Cloneable Override Deprecated FunctionalInterface SuppressWarnings Builder Response Request"
).split()
#: How sure a call is by how its receiver was found, and its kind (fixed values).
JAVA_CALL, PYTHON_CALL = (0.6, "direct"), (0.4, "indirect")
LANGUAGE_SERVER = 0.99
RELATION = ["rel_type", "source", "target"]

# --- operators ---------------------------------------------------------------


def _once(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*RELATION)
    for p in parts[1:]:
        out = out.unionByName(p.select(*RELATION))
    return out.where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()


def java_type(kind: Column) -> Column:
    """The name of a declared type of Java without type arguments and brackets; null for those that no project declares."""
    bare = F.regexp_extract(kind, r"^([^<\[]+)", 1)
    foreign = bare.isin("", *JAVA_TYPES) | F.startswith(bare, F.lit("java.")) | bare.rlike(r"^[A-Z][0-9]?$")
    return F.when(~foreign, bare)


def _in_package(name: Column, package: Column) -> Column:
    """A name with a dot as it is, others in the package, if there is one."""
    return F.when(F.contains(name, F.lit(".")) | F.coalesce(package, F.lit("")).isin(""), name).otherwise(F.concat_ws(".", package, name))


def java_relations(classes: DataFrame, supers: DataFrame, interfaces: DataFrame, uses: DataFrame) -> DataFrame:
    """(rel_type, source, target) of Java: `classes` (id, package), `supers` (id, name), `interfaces` (id, name) and `uses` (id, type) of fields and parameters.

    Targets are names in the class's own package unless they hold a dot; what
    they are in truth is found by repairing targets afterwards.
    """
    def to(rows: DataFrame, kind: str, name: Column) -> DataFrame:
        r = rows.withColumn("__n", name).where(F.col("__n").isNotNull()).join(classes.select("id", "package"), "id")
        return r.select(F.lit(kind).alias("rel_type"), F.col("id").alias("source"), _in_package(F.col("__n"), F.col("package")).alias("target"))

    return _once(to(supers, "inheritance", F.col("name")), to(interfaces, "implementation", F.col("name")), to(uses, "dependency", java_type(F.col("type"))))


#: C++: what stands around a type's name, and how maps and smart pointers name what they hold (fixed patterns).
_MAP_KEY = r"\b((?:unordered_)?(?:multi)?map)<[^<>,]*,"
_DELETER = r"\b(unique_ptr|shared_ptr|weak_ptr)<([^<>,]*),[^<>]*>"
_NAME = r"[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*"


def cpp_types(kind: Column) -> Column:
    """The names in a type of C++, without std:: and parameters of templates; of a map what it holds, not its key."""
    k = F.regexp_replace(F.regexp_replace(kind, r"\bstd::", ""), _DELETER, "$1<$2>")
    k = F.regexp_replace(k, _MAP_KEY, "$1<")
    return F.array_distinct(F.filter(F.regexp_extract_all(k, F.lit(_NAME), F.lit(0)), lambda x: ~x.rlike(r"^[A-Z]{1,2}$")))


def cpp_field(kind: Column) -> Column:
    """Whether a field owns what it names: composition for smart pointers and values, aggregation for raw pointers and references, also inside a container."""
    smart = kind.rlike(r"\b(?:unique_ptr|shared_ptr|weak_ptr)\b")
    reference = F.regexp_replace(kind, "<.*>", "").rlike("[*&]")
    return F.when(smart, "composition").when(reference | F.contains(kind, F.lit("*")), "aggregation").otherwise("composition")


def cpp_relations(bases: DataFrame, fields: DataFrame, uses: DataFrame, names: DataFrame) -> DataFrame:
    """The same of C++: `bases` (id, name), `fields` (id, type), `uses` (id, type) of parameters and results; `names` (name, id) says what a name, qualified or not, stands for.

    Names that nothing known has, and a class's relations to itself, are left
    out; of several entities of a name the least id counts.
    """
    known = names.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("id").alias("target"))
    held = lambda rows, kind: rows.select(F.col("id").alias("source"), kind.alias("rel_type"), F.explode(cpp_types(F.col("type"))).alias("name"))
    all_ = bases.select(F.col("id").alias("source"), F.lit("inheritance").alias("rel_type"), "name")
    all_ = all_.unionByName(held(fields, cpp_field(F.col("type")))).unionByName(held(uses, F.lit("dependency")))
    return _once(all_.join(known, "name").where(F.col("source") != F.col("target")))


def kotlin_relations(supers: DataFrame, fields: DataFrame, entities: DataFrame) -> DataFrame:
    """The same of Kotlin: `supers` and `fields` (id, package, name) name types, `entities` are (id, name, entity_type, ordinal).

    A name is the first entity of that name, else the one of the same package,
    else the entity it is the id of. A supertype that is an interface is
    implemented, any other inherited; fields are composition.
    """
    named = entities.where(F.col("name").isNotNull()).groupBy("name").agg(F.min_by(F.struct("id", "entity_type"), F.struct("ordinal", "id")).alias("by_name"))
    by_id = entities.groupBy("id").agg(F.max("entity_type").alias("entity_type"))
    rows = supers.withColumn("kind", F.lit("super")).unionByName(fields.withColumn("kind", F.lit("field")))
    own, full = by_id.select(F.col("id").alias("__own"), F.struct("id", "entity_type").alias("by_package")), by_id.select(F.col("id").alias("name"), F.struct("id", "entity_type").alias("by_id"))
    r = rows.join(named, "name", "left").withColumn("__own", F.concat_ws(".", "package", "name")).join(own, "__own", "left").join(full, "name", "left")
    r = r.withColumn("t", F.coalesce("by_name", "by_package", F.when(F.contains("name", F.lit(".")), F.col("by_id")))).where(F.col("t").isNotNull() & (F.col("id") != F.col("t.id")))
    kind = F.when(F.col("kind") == "field", "composition").when(F.col("t.entity_type") == "interface", "implementation").otherwise("inheritance")
    return _once(r.select(kind.alias("rel_type"), F.col("id").alias("source"), F.col("t.id").alias("target")))


def receiver_calls(sites: DataFrame, known: DataFrame, language: str) -> DataFrame:
    """(source, target, source_method, target_method, call_type, confidence): call sites (id, package, method, receiver, called) whose receiver is known, each once.

    In Java `known` (name) are types, and the target lies in the caller's
    package; in Python they are fields, and the target is the field's name.
    """
    confidence, kind = {"java": JAVA_CALL, "python": PYTHON_CALL}[language]
    s = sites.join(known.select(F.col("name").alias("receiver")).distinct(), "receiver", "left_semi")
    target = _in_package(F.col("receiver"), F.col("package")) if language == "java" else F.col("receiver")
    return s.select(
        F.col("id").alias("source"), target.alias("target"), F.col("method").alias("source_method"), F.col("called").alias("target_method")
    ).distinct().withColumns({"call_type": F.lit(kind), "confidence": F.lit(confidence)})


def flow_calls(calls: DataFrame) -> DataFrame:
    """(source, target, source_method, target_method, call_type, confidence) of Go: calls (from, to, type, confidence) split at their last dots, once per pair of ends.

    Ends without a package are left out; indirect calls are those of an
    interface; of several calls between two ends the surest counts.
    """
    last, rest = lambda c: F.element_at(F.split(c, r"\."), -1), lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    kind = F.when(F.col("type") == "indirect", "interface").otherwise(F.col("type"))
    once = calls.groupBy("from", "to").agg(F.max_by(F.struct(kind.alias("call_type"), "confidence"), F.struct("confidence", "type")).alias("x"))
    out = once.select(rest("from").alias("source"), rest("to").alias("target"), last("from").alias("source_method"), last("to").alias("target_method"), "x.call_type", "x.confidence")
    return out.where((F.col("source") != "") & (F.col("target") != ""))


def go_dependencies(imports: DataFrame, packages: DataFrame, module: str) -> DataFrame:
    """(rel_type, source, target) of Go: imports (package, path) of known packages (package) of the module itself."""
    prefix = F.lit(f"{module}/")
    i = imports.where(F.startswith("path", prefix)).select(F.col("package").alias("source"), F.expr(f"substring(path, {len(module) + 2})").alias("target"))
    known = packages.select(F.col("package").alias("target")).distinct()
    return _once(i.where(F.col("source") != F.col("target")).join(known, "target", "left_semi").withColumn("rel_type", F.lit("dependency")))


def with_language_server(found: DataFrame, matched: DataFrame) -> DataFrame:
    """(raw_id, struct, interface, confidence, origin): what a language server found, and what names say of the structs it knows nothing of.

    `found` has (raw_id, struct, interface), `matched` the same by names with
    confidence.
    """
    a = found.select("raw_id", "struct", "interface").distinct().withColumns({"confidence": F.lit(LANGUAGE_SERVER), "origin": F.lit("server")})
    b = matched.join(found.select("raw_id", "struct").distinct(), ["raw_id", "struct"], "left_anti").select("raw_id", "struct", "interface", "confidence", F.lit("names").alias("origin"))
    return a.unionByName(b)


def spawns(bodies: DataFrame) -> DataFrame:
    """(source, target, spawn_type): goroutines that bodies start; `bodies` has (package, owner, goes ARRAY<STRUCT<line, function, args>>), the owner being the function or Type.method."""
    at = F.concat_ws(".", "package", "owner")
    s = bodies.select(at.alias("source"), F.explode("goes").alias("g"))
    kind = F.when(F.coalesce("g.function", F.lit("")).isin("", "<anonymous>"), "go-func").otherwise("go-stmt")
    return s.select("source", F.concat(F.col("source"), F.lit(".spawn-"), F.col("g.line").cast("string")).alias("target"), kind.alias("spawn_type"))


def channels(bodies: DataFrame) -> DataFrame:
    """(id, name, package, line): channels made in bodies with (package, owner, ops ARRAY<STRUCT<operation, name, line>>)."""
    o = bodies.select("package", F.explode("ops").alias("o")).where(F.col("o.operation") == "make")
    return o.select(_channel(F.col("o.line")).alias("id"), F.col("o.name").alias("name"), "package", F.col("o.line").alias("line"))


def _channel(line: Column) -> Column:
    return F.concat(F.lit("chan-"), F.col("package"), F.lit("-"), line.cast("string"))


def channel_edges(bodies: DataFrame) -> DataFrame:
    """(source, target, edge_type): `make` from a body to its named channels, `recv` from a channel to the goroutine that gets it as its first argument that is a channel of the body.

    A name made twice in a body is its last channel.
    """
    at = F.concat_ws(".", "package", "owner")
    made = bodies.select("package", at.alias("body"), F.explode("ops").alias("o")).where((F.col("o.operation") == "make") & (F.coalesce("o.name", F.lit("")) != ""))
    made = made.select("body", F.col("o.name").alias("name"), _channel(F.col("o.line")).alias("channel"), F.col("o.line").alias("line"))
    scope = made.groupBy("body", "name").agg(F.max_by("channel", "line").alias("channel"))
    goes = bodies.select(at.alias("body"), F.explode("goes").alias("g")).select("body", F.col("g.line").alias("line"), F.posexplode("g.args").alias("pos", "name"))
    first = goes.join(scope, ["body", "name"]).groupBy("body", "line").agg(F.min_by("channel", "pos").alias("channel"))
    recv = first.select(F.col("channel").alias("source"), F.concat(F.col("body"), F.lit(".spawn-"), F.col("line").cast("string")).alias("target"), F.lit("recv").alias("edge_type"))
    return made.select(F.col("body").alias("source"), F.col("channel").alias("target"), F.lit("make").alias("edge_type")).unionByName(recv)


def file_package(file: Column, root: str | None = None, java: bool = False) -> Column:
    """The package of a file: of Java the Maven module, of files below a known root their directory, else the first directory after src/; empty where there is none."""
    path = F.regexp_replace(file, r"\\", "/")
    first = F.regexp_extract(path, r"^([^/]+)/src/(?:main|test)/java/", 1)
    module = F.when(first != "", first).otherwise(F.regexp_extract(path, r"/([^/]+)/src/(?:main|test)/java/", 1))
    after = F.when(F.contains(path, F.lit("/src/")), F.regexp_extract(path, r"/src/(.*)$", 1)).otherwise(F.regexp_replace(path, "^src/", ""))
    out = F.regexp_extract(after, "^([^/]*)/", 1)
    if root is not None:
        below = F.lit(root.rstrip("/") + "/")
        rel = F.when(F.startswith(path, below), F.substring(path, len(root.rstrip("/")) + 2, F.length(path)))
        out = F.when(rel.isNotNull(), F.when(F.contains(rel, F.lit("/")), F.regexp_replace(rel, "/[^/]*$", "")).otherwise("")).otherwise(out)
    if java:
        out = F.when((module != "") & ~module.rlike(r"^java\d+$") & (module != "META-INF"), module).otherwise(out)
    return out


def canonical(entities: DataFrame) -> DataFrame:
    """Entities in one fixed order, by id and name, with their members by name, type and visibility: by the bytes of these, joined by |, a null being an empty text."""
    text = lambda m, f: F.coalesce(m[f], F.lit(""))
    key = lambda m: F.concat_ws("|", text(m, "name"), text(m, "type"), text(m, "visibility"))
    order = F.array_sort("members", lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    e = entities.withColumn("members", order) if "members" in entities.columns else entities
    return e.orderBy(F.concat_ws("|", F.coalesce("key", F.lit("")), F.coalesce("name", F.lit(""))))


def merge_results(*results: DataFrame) -> DataFrame:
    """The rows of several files' or runs' results; columns that one lacks are null there."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def distinct_edges(es: DataFrame, kind: str = "rel_type") -> DataFrame:
    """Edges once per type and ends, the first by id."""
    return es.groupBy(kind, "source", "target").agg(F.min("id").alias("id"))


#: Weights of the parts of a diagram's quality, and what it needs to be acceptable (fixed values).
QUALITY = {"readability": 0.25, "completeness": 0.35, "consistency": 0.2, "complexity": 0.2}
ACCEPTABLE = 60


def complexity(entities: DataFrame, rels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, complexity): 100 less 2 for every entity beyond 20, relation beyond 30 and connection of an entity beyond 10; between 0 and 100.

    `rels` has (keys, source, target). Groups without entities have no row.
    """
    e = entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("e"))
    r = rels.groupBy(*keys).agg(F.count(F.lit(1)).alias("r"))
    ends = rels.select(*keys, F.explode(F.array("source", "target")).alias("end")).groupBy(*keys, "end").agg(F.count(F.lit(1)).alias("c"))
    busy = ends.where(F.col("c") > 10).groupBy(*keys).agg(F.sum(F.col("c") - 10).alias("b"))
    j = e.join(r, keys, "left").join(busy, keys, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    lost = 2 * (F.greatest(F.col("e") - 20, F.lit(0)) + F.greatest(n("r") - 30, F.lit(0)) + n("b"))
    return j.select(*keys, F.greatest(F.lit(0), 100 - lost).cast("bigint").alias("complexity"))


def quality(parts: DataFrame) -> DataFrame:
    """Rows with the four parts of QUALITY, their weighted score, rounded half up, and whether it is acceptable."""
    score = F.floor(sum((F.col(c) * w for c, w in QUALITY.items()), F.lit(0.0)) + 0.5)
    return parts.withColumn("score", score).withColumn("valid", F.col("score") >= ACCEPTABLE)


def named(metrics: DataFrame, part: str, by: str = "fan_in", column: str = "package") -> DataFrame:
    """Package figures whose name holds a text, the largest first, of equal ones by name."""
    return metrics.where(F.contains(column, F.lit(part))).orderBy(F.desc(by), column)


# --- queries -----------------------------------------------------------------

_JAVA_SQL = "CASE WHEN regexp_extract({0}, '^([^<\\[]+)', 1) NOT IN (''," + ", ".join(f"'{t}'" for t in JAVA_TYPES) + ") AND NOT starts_with({0}, 'java.') AND NOT regexp_matches(regexp_extract({0}, '^([^<\\[]+)', 1), '^[A-Z][0-9]?$') THEN regexp_extract({0}, '^([^<\\[]+)', 1) END"
_PKG_OF = "regexp_replace({0}, '\\.[^.]*$', '')"


def _of_language(spark: SparkSession, d: str, ext: str) -> DataFrame:
    e = current_entities(spark, d, "name", "entity_type", "members", "extends", "implements", "source_location", "first_seen_at")
    e = e.where(F.endswith("source_location.file", F.lit(ext))).withColumnRenamed("key", "id")
    return e.withColumn("package", F.regexp_replace("id", r"\.[^.]*$", ""))


def _rows(e: DataFrame, column: str) -> DataFrame:
    return e.select("id", F.explode(column).alias("name")).where(F.col("name").isNotNull())


def _uses(e: DataFrame, results: bool) -> DataFrame:
    m = e.select("id", F.explode("members").alias("m"))
    out = m.select("id", F.explode("m.parameters").alias("p")).select("id", F.col("p.type").alias("type"))
    return (out.unionByName(m.select("id", F.col("m.return_type").alias("type"))) if results else out).where(F.col("type").isNotNull())


def _fields(e: DataFrame) -> DataFrame:
    return e.select("id", F.explode("members").alias("m")).select("id", F.col("m.field_type").alias("type")).where(F.col("type").isNotNull())


_LANG = lambda ext: f"""l AS (SELECT key AS id, name, entity_type, members, extends, implements, {_PKG_OF.format('key')} AS package FROM ent WHERE ends_with(source_location.file, '{ext}')),
  mm AS (SELECT id, package, unnest(members) AS m FROM l), pa AS (SELECT id, package, unnest(m.parameters) AS p FROM mm)"""  # noqa: E731


@query(f"""WITH {ENT}, {_LANG('.java')}, t AS (SELECT 'inheritance' AS rel_type, id, package, unnest(extends) AS name FROM l UNION ALL SELECT 'implementation', id, package, unnest(implements) FROM l
      UNION ALL SELECT 'dependency', id, package, {_JAVA_SQL.format('m.field_type')} FROM mm WHERE m.field_type IS NOT NULL UNION ALL SELECT 'dependency', id, package, {_JAVA_SQL.format('p.type')} FROM pa WHERE p.type IS NOT NULL)
    SELECT DISTINCT rel_type, id AS source, CASE WHEN contains(name, '.') THEN name ELSE package || '.' || name END AS target FROM t WHERE name IS NOT NULL""")
def mapped_java(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the Java entities out of their declarations."""
    e = _of_language(spark, d, ".java")
    return java_relations(e, _rows(e, "extends"), _rows(e, "implements"), _fields(e).unionByName(_uses(e, False)))


_CPP_SQL = "regexp_replace(regexp_replace(regexp_replace({0}, '\\bstd::', '', 'g'), '\\b(unique_ptr|shared_ptr|weak_ptr)<([^<>,]*),[^<>]*>', '\\1<\\2>', 'g'), '\\b((?:unordered_)?(?:multi)?map)<[^<>,]*,', '\\1<', 'g')"
_OWN = "CASE WHEN regexp_matches({0}, '\\b(unique_ptr|shared_ptr|weak_ptr)\\b') THEN 'composition' WHEN regexp_matches(regexp_replace({0}, '<.*>', '', 'g'), '[*&]') OR contains({0}, '*') THEN 'aggregation' ELSE 'composition' END"


@query(f"""WITH {ENT}, {_LANG('.cpp')}, kn AS (SELECT name, min(id) AS target FROM (SELECT key AS name, key AS id FROM ent UNION ALL SELECT v, key FROM ent, (VALUES ('Node'), ('Owner')) x(v) WHERE name LIKE v || '%')
        GROUP BY 1),
      t AS (SELECT 'inheritance' AS rel_type, id AS source, lower(unnest(extends)) AS name FROM l
        UNION ALL SELECT {_OWN.format('m.field_type')}, id, unnest(regexp_extract_all({_CPP_SQL.format('m.field_type')}, '{_NAME}')) FROM mm WHERE m.field_type IS NOT NULL
        UNION ALL SELECT 'dependency', id, unnest(regexp_extract_all({_CPP_SQL.format('p.type')}, '{_NAME}')) FROM pa WHERE p.type IS NOT NULL
        UNION ALL SELECT 'dependency', id, unnest(regexp_extract_all({_CPP_SQL.format('m.return_type')}, '{_NAME}')) FROM mm WHERE m.return_type IS NOT NULL)
    SELECT DISTINCT rel_type, source, target FROM t JOIN kn USING (name) WHERE source <> target AND NOT regexp_matches(name, '^[A-Z]{{1,2}}$')""")
def mapped_cpp(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the C++ entities; the types Node and Owner stand for the first entity whose name begins so."""
    e = _of_language(spark, d, ".cpp")
    all_ = current_entities(spark, d, "name").select(F.col("key").alias("id"), F.col("name").alias("n"))
    alias = F.explode(F.array(*[F.when(F.startswith("n", F.lit(v)), F.lit(v)) for v in ("Node", "Owner")]))
    names = all_.select(F.col("id").alias("name"), "id").unionByName(all_.select(alias.alias("name"), "id").where(F.col("name").isNotNull()))
    return cpp_relations(_rows(e, "extends").withColumn("name", F.lower("name")), _fields(e), _uses(e, True), names)


@query(f"""WITH {ENT}, {_LANG('.kt')}, t AS (SELECT id, package, lower(unnest(list_concat(coalesce(extends, []), coalesce(implements, [])))) AS name FROM l)
    SELECT DISTINCT CASE WHEN ent.entity_type = 'interface' THEN 'implementation' ELSE 'inheritance' END AS rel_type, t.id AS source, ent.key AS target FROM t JOIN ent ON ent.key = t.name WHERE t.id <> ent.key""")
def mapped_kotlin(spark: SparkSession, d: str) -> DataFrame:
    """Supertypes of the Kotlin entities: interfaces are implemented, others inherited."""
    e = _of_language(spark, d, ".kt")
    supers = e.select("id", "package", F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("extends", "implements")))).alias("name")).where(F.col("name").isNotNull())
    all_ = current_entities(spark, d, "name", "entity_type", "first_seen_at").select(F.col("key").alias("id"), "name", "entity_type", F.col("first_seen_at").alias("ordinal"))
    return kotlin_relations(supers.withColumn("name", F.lower("name")), supers.select("id", "package", "name").limit(0), all_)


@query(f"""WITH {EDGE}, c AS (SELECT src || '.' || source_method AS f, dst || '.' || target_method AS t, call_type, confidence FROM edge WHERE rel_type = 'call' AND source_method IS NOT NULL AND target_method IS NOT NULL),
      o AS (SELECT f, t, arg_max({{'k': CASE WHEN call_type = 'indirect' THEN 'interface' ELSE call_type END, 'c': confidence}}, (confidence, call_type)) AS x FROM c GROUP BY 1, 2)
    SELECT regexp_extract(f, '^(.*)\\.[^.]*$', 1) AS source, regexp_extract(t, '^(.*)\\.[^.]*$', 1) AS target, regexp_extract(f, '[^.]*$') AS source_method, regexp_extract(t, '[^.]*$') AS target_method, x.k AS call_type, x.c AS confidence FROM o""")
def mapped_flow_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls between methods, put together from a flow's ends."""
    e = edges(spark, d, "source_method", "target_method", "call_type", "confidence").where((F.col("rel_type") == "call") & F.col("source_method").isNotNull() & F.col("target_method").isNotNull())
    return flow_calls(e.select(F.concat_ws(".", "src", "source_method").alias("from"), F.concat_ws(".", "dst", "target_method").alias("to"), F.col("call_type").alias("type"), "confidence"))


@query(f"""WITH {EDGE}, n AS (SELECT key, lower(name) AS name FROM ent WHERE name LIKE 'Order%')
    SELECT DISTINCT src AS source, n.name AS target, source_method, target_method, 'indirect' AS call_type, 0.4::DOUBLE AS confidence FROM edge JOIN n ON n.key = dst WHERE rel_type = 'call'""")
def mapped_field_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls on fields that hold entities whose name begins with Order."""
    e = current_entities(spark, d, "name").select(F.col("key").alias("dst"), F.lower("name").alias("receiver"), "name")
    known = e.where(F.startswith("name", F.lit("Order"))).select(F.col("receiver").alias("name"))
    sites = edges(spark, d, "source_method", "target_method").where(F.col("rel_type") == "call").join(e.drop("name"), "dst").select(F.col("src").alias("id"), F.lit(None).cast("string").alias("package"), F.col("source_method").alias("method"), "receiver", F.col("target_method").alias("called"))
    return receiver_calls(sites, known, "python")


@query(f"""WITH {ENT} SELECT key, CASE WHEN contains(f, '/src/') THEN regexp_extract(regexp_extract(f, '/src/(.*)$', 1), '^([^/]*)/', 1) ELSE regexp_extract(regexp_replace(f, '^src/', ''), '^([^/]*)/', 1) END AS package
    FROM (SELECT key, source_location.file AS f FROM ent) WHERE f IS NOT NULL""")
def file_packages(spark: SparkSession, d: str) -> DataFrame:
    """The package of every entity by its file."""
    e = current_entities(spark, d, "source_location").where(F.col("source_location.file").isNotNull())
    return e.select("key", file_package(F.col("source_location.file")).alias("package"))


@query(f"""WITH {EDGE}, v AS (SELECT scope_key, count(*) AS e FROM ent WHERE scope_key IS NOT NULL GROUP BY 1), r AS (SELECT scope_key, count(*) AS r FROM edge GROUP BY 1),
      b AS (SELECT scope_key, sum(c - 10) AS b FROM (SELECT scope_key, x, count(*) AS c FROM (SELECT scope_key, src AS x FROM edge UNION ALL SELECT scope_key, dst FROM edge) GROUP BY 1, 2) WHERE c > 10 GROUP BY 1)
    SELECT scope_key, greatest(0, 100 - 2 * (greatest(e - 20, 0) + greatest(coalesce(r, 0) - 30, 0) + coalesce(b, 0)))::BIGINT AS complexity FROM v LEFT JOIN r USING (scope_key) LEFT JOIN b USING (scope_key)""")
def scope_complexity(spark: SparkSession, d: str) -> DataFrame:
    """How complex a diagram of a whole scope would be."""
    e = current_entities(spark, d, "scope_key").where(F.col("scope_key").isNotNull())
    return complexity(e, edges(spark, d, "scope_key").select("scope_key", F.col("src").alias("source"), F.col("dst").alias("target")), ["scope_key"])
