"""Putting extracted pieces together: declarative extraction, qualification, grouping, entry points, summaries.

Where the first of several candidates wins, an explicit ordinal says which is
first; nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.functions.text import dirname
from strataspark.operators.graph import degrees
from strataspark.plans.registry import register
from strataspark.sources.graph import EDGE, ENT, REL, edges, relations
from strataspark.sources.tables import current_entities, table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

# --- operators ---------------------------------------------------------------

#: Declarations of languages: (language, kind, pattern with one group for the name and one for what it extends, or none) (fixed values).
DECLARATIONS = [
    ("typescript", "class", r"class\s+(\w+)(?:\s+extends\s+(\w+))?"),
    ("typescript", "interface", r"interface\s+(\w+)(?:\s+extends\s+(\w+))?"),
    ("python", "class", r"class\s+(\w+)\((\w*)\)\s*:"),
    ("go", "method", r"func\s+\(\w+\s+\*?(\w+)\)\s+(\w+)\("),
]


def declarations(files: DataFrame, key: str = "file", text: str = "text", rules: list = DECLARATIONS) -> DataFrame:
    """(file, language, kind, name, other): what declarative rules find in texts. `other` is the supertype, of a method its name; empty where there is none."""
    out = None
    for language, kind, pattern in rules:
        names, others = (F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i)) for i in (1, 2))
        rows = files.select(F.col(key).alias("file"), F.explode(F.arrays_zip(names.alias("n"), others.alias("o"))).alias("x"))
        part = rows.select("file", F.lit(language).alias("language"), F.lit(kind).alias("kind"), F.col("x.n").alias("name"), F.coalesce("x.o", F.lit("")).alias("other"))
        out = part if out is None else out.unionByName(part)
    return out


#: What a declaration says of others: (relation, pattern with a group for the name and one for the list of the others) (fixed values).
SUPERTYPES = [
    ("inheritance", r"\bclass\s+(\w+)(?:<[^<>{}]*>)?\s+extends\s+([\w.]+)"),
    ("implementation", r"\bclass\s+(\w+)[^{}();]*?\simplements\s+([\w.]+(?:<[^<>{}]*>)?(?:\s*,\s*[\w.]+(?:<[^<>{}]*>)?)*)"),
    ("inheritance", r"\binterface\s+(\w+)(?:<[^<>{}]*>)?\s+extends\s+([\w.]+(?:<[^<>{}]*>)?(?:\s*,\s*[\w.]+(?:<[^<>{}]*>)?)*)"),
    ("inheritance", r"\bclass\s+(\w+)\(([\w.]+(?:\s*,\s*[\w.]+)*)(?:\s*,\s*\w+\s*=[^)]*)?\)\s*:"),
    ("inheritance", r"\bclass\s+(\w+)\s*:\s*(?:public|protected|private)\s+([\w:]+(?:\s*,\s*(?:public|protected|private)\s+[\w:]+)*)"),
]
#: Arrows of class diagrams, and what is their source (fixed values).
ARROWS = [("inheritance", r"(\w+)\s*<\|--\s*(\w+)", 2), ("composition", r"(\w+)\s*\*--\s*(\w+)", 1), ("aggregation", r"(\w+)\s*o--\s*(\w+)", 1), ("dependency", r"(\w+)\s*\.\.>\s*(\w+)", 1), ("association", r"(\w+)\s*-->\s*(\w+)", 1), ("implementation", r"(\w+)\s*<\|\.\.\s*(\w+)", 2)]


def text_relations(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(file, rel_type, source, target): what declarations of classes and arrows of class diagrams in texts say, each once per file. Type arguments and access of base classes are left out."""
    t = files.select(F.col(key).alias("file"), F.col(text).alias("t")).where(F.col("t").isNotNull())

    def found(pattern: str) -> DataFrame:
        a, b = (F.regexp_extract_all("t", F.lit(pattern), F.lit(i)) for i in (1, 2))
        return t.select("file", F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("x")).select("file", "x.a", "x.b")

    out = None
    for kind, pattern in SUPERTYPES:
        bare = F.regexp_replace(F.regexp_replace("b", "<[^<>]*>", ""), r"\b(?:public|protected|private)\s+", "")
        part = found(pattern).select("file", F.lit(kind).alias("rel_type"), F.col("a").alias("source"), F.explode(F.split(bare, r"\s*,\s*")).alias("target"))
        out = part if out is None else out.unionByName(part)
    for kind, pattern, source in ARROWS:
        ends = ("a", "b") if source == 1 else ("b", "a")
        out = out.unionByName(found(pattern).select("file", F.lit(kind).alias("rel_type"), F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target")))
    return out.where(F.trim("target") != "").distinct()


def first_by_name(entities: DataFrame, keys: list[str], name: str, value: str, ordinal: str) -> DataFrame:
    """(keys, name, value): of entities with the same name the first by ordinal."""
    return entities.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min_by(value, F.struct(ordinal, value)).alias(value))


def repair_targets(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose unknown target is replaced by the first entity with the same last dotted part; others stay."""
    known = entities.select(F.col("key").alias("target"), F.lit(True).alias("known"))
    short = entities.select(F.element_at(F.split("key", r"\."), -1).alias("short"), "key")
    first = short.groupBy("short").agg(F.min("key").alias("repaired"))
    r = rels.join(known, "target", "left").withColumn("short", F.element_at(F.split("target", r"\."), -1)).join(first, "short", "left")
    return r.withColumn("target", F.when(F.col("known"), F.col("target")).otherwise(F.coalesce("repaired", "target"))).drop("short", "known", "repaired")


def merge_pairs(headers: DataFrame, bodies: DataFrame, key: str = "name") -> DataFrame:
    """Headers and implementations of the same qualified name as one row: methods of both, the header's fields unless it has none."""
    h = headers.select(key, F.col("methods").alias("hm"), F.col("fields").alias("hf"))
    b = bodies.select(key, F.col("methods").alias("bm"), F.col("fields").alias("bf"))
    none = F.array().cast("array<string>")
    hm, bm, hf, bf = (F.coalesce(c, none) for c in ("hm", "bm", "hf", "bf"))
    return h.join(b, key, "full").select(
        key, F.sort_array(F.array_union(hm, bm)).alias("methods"), F.when(F.size(hf) > 0, hf).otherwise(bf).alias("fields"),
        F.col("hm").isNotNull().alias("in_header"), F.col("bm").isNotNull().alias("in_body"),
    )


def module_packages(entities: DataFrame) -> DataFrame:
    """(module, package): every dotted prefix of ids with the package of its first entity; ids in order."""
    p = F.split("key", r"\.")
    pre = entities.where(F.size(p) > 1).select("key", "package", F.explode(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.array_join(F.slice(p, 1, k), "."))).alias("module"))
    return pre.groupBy("module").agg(F.min_by("package", "key").alias("package"))


def groups(entities: DataFrame, rules: list[tuple[str, str, int]], other: str = "other") -> DataFrame:
    """Entities with `grp`: the label of the rule (pattern on the file, label, priority) of the highest priority that matches, of equal ones the first."""
    ordered = sorted(enumerate(rules), key=lambda x: (x[1][2], -x[0]))
    label = F.lit(other)
    for _, (pattern, name, _) in ordered:
        label = F.when(F.col("file").rlike(pattern), name).otherwise(label)
    return entities.withColumn("grp", label)


def limited(grouped: DataFrame, groups_: int, members: int, group: str, member: str) -> DataFrame:
    """The largest groups, each with its first members: (group, member, group_rank, member_rank)."""
    sizes = grouped.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    big = sizes.orderBy(F.desc("size"), group).limit(groups_)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(member))
    kept = grouped.join(big.select(group), group, "left_semi").withColumn("member_rank", rank)
    return kept.where(F.col("member_rank") <= members).select(group, member, "member_rank")


#: Calls that register an entry point: framework -> (function, end of the function, part of the receiver's type, protocol, HTTP method, argument that holds the handler) (fixed values).
FRAMEWORK_CALLS = {
    "net/http": [("HandleFunc", None, None, "http", None, 1), ("Handle", None, None, "http", None, 1)],
    "gin": [(m, None, None, "http", m.upper(), 1) for m in ("GET", "POST", "PUT", "DELETE", "PATCH", "Any")],
    "gorilla/mux": [("Handle", None, "mux.Router", "http", None, 1), ("HandleFunc", None, "mux.Router", "http", None, 1)],
    "echo": [(m, None, None, "http", m, 1) for m in ("GET", "POST", "PUT", "DELETE", "PATCH")],
    "chi": [(m, None, None, "http", m.upper(), 1) for m in ("Get", "Post", "Put", "Delete", "Patch")],
    "cobra": [("AddCommand", None, None, "cli", None, 1)],
    "grpc": [(None, "Server", None, "grpc", None, 1)],
    "kafka-go": [("ConsumePartition", None, None, "message", None, 1)],
    "sarama": [("ConsumePartition", None, None, "message", None, 1)],
    "nats": [("Subscribe", None, None, "message", None, 1), ("QueueSubscribe", None, None, "message", None, 1)],
    "cron": [("AddFunc", None, None, "scheduler", None, 1), ("AddJob", None, None, "scheduler", None, 1)],
    "mcp-go": [("AddTool", None, None, "mcp", None, 1), ("RegisterTool", None, None, "mcp", None, 1)],
    "mcp-gosdk": [("AddTool", None, None, "mcp", None, 2)],
}
#: Ends of functions that register something where no framework is known (fixed values).
GENERIC_ENDS = ("AddTool", "RegisterTool", "AddCommand", "HandleFunc")


def _handler(args: Column, at: int) -> Column:
    """The handler among a call's arguments; none for a function written in place."""
    arg = F.coalesce(F.get(args, F.lit(at)), F.lit(""))
    return F.when(F.startswith(arg, F.lit("func(")), "").otherwise(arg)


def entry_points(calls: DataFrame, frameworks: list[str], custom: dict[str, list[tuple]] | None = None) -> DataFrame:
    """Calls that register an entry point, with framework, protocol, http_method, path and handler; others are left out.

    `calls` has function, receiver_type and args ARRAY<STRING>. Patterns of the
    detected frameworks are tried in their order, then those of `custom`, which
    are written like FRAMEWORK_CALLS; the first that matches counts. An unknown
    receiver fits every pattern.
    """
    patterns = [(f, p) for f in frameworks for p in FRAMEWORK_CALLS.get(f, [])] + [(f, p) for f, ps in (custom or {}).items() for p in ps]
    found = F.lit(None).cast("struct<framework:string,protocol:string,http_method:string,handler:string>")
    for framework, (function, end, receiver, protocol, method, at) in reversed(patterns):
        fits = F.lit(True)
        if function is not None:
            fits = fits & (F.col("function") == function)
        if end is not None:
            fits = fits & F.endswith("function", F.lit(end))
        if receiver is not None:
            fits = fits & (F.coalesce("receiver_type", F.lit("")).isin("") | F.contains("receiver_type", F.lit(receiver)))
        made = F.struct(
            F.lit(framework).alias("framework"), F.lit(protocol).alias("protocol"), F.lit(method).cast("string").alias("http_method"), _handler(F.col("args"), at).alias("handler")
        )
        found = F.when(fits, made).otherwise(found)
    path = F.coalesce(F.get("args", F.lit(0)), F.lit("")).alias("path")
    return calls.withColumn("__e", found).where(F.col("__e").isNotNull()).select(*calls.columns, "__e.*", path)


def with_generic(entries: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Entry points, and for groups that have none the calls of a function that by its end registers something, as custom ones."""
    end = F.lit(False)
    for e in GENERIC_ENDS:
        end = end | F.endswith("function", F.lit(e))
    rest = calls.where(end).join(entries.select(*keys).distinct(), keys, "left_anti").select(
        *calls.columns, F.lit("generic-heuristic").alias("framework"), F.lit("custom").alias("protocol"), F.lit(None).cast("string").alias("http_method"),
        _handler(F.col("args"), 1).alias("handler"), F.coalesce(F.get("args", F.lit(0)), F.lit("")).alias("path"),
    )
    return entries.unionByName(rest)


def of_protocols(entries: DataFrame, chains: DataFrame, protocols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entry points (id, protocol, ...) of some protocols, all if none is named, and the chains (entry_point, ...) that begin at them."""
    if not protocols:
        return entries, chains
    kept = entries.where(F.col("protocol").isin(*protocols))
    return kept, chains.join(kept.select(F.col("id").alias("entry_point")).distinct(), "entry_point", "left_semi")


def call_class(calls: DataFrame, context: DataFrame, interfaces: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with call_type: interface if the receiver's declared type is one, else direct.

    `calls` has receiver (as `s.store`; the last part counts), `context` (keys,
    name, type) the fields and parameters in reach, `interfaces` (name). A
    pointer's star and a package before the type do not matter.
    """
    stripped = F.regexp_replace("type", r"^\*", "")
    typed = context.where(F.col("name").isNotNull()).groupBy(*keys, F.col("name").alias("__var")).agg(F.max(stripped).alias("__type"))
    # a whole name and the part after the last dot are looked up by one join
    names = interfaces.select(F.col("name").alias("__name")).distinct()
    forms = typed.select(*keys, "__var", F.explode(F.array_distinct(F.array("__type", F.element_at(F.split("__type", r"\."), -1)))).alias("__name"))
    known = forms.join(names, "__name").select(*keys, "__var").distinct().withColumn("__i", F.lit(True))
    c = calls.withColumn("__var", F.element_at(F.split("receiver", r"\."), -1)).join(known, [*keys, "__var"], "left")
    return c.withColumn("call_type", F.when(F.col("__i"), "interface").otherwise("direct")).drop("__var", "__i")


#: Packages of the standard library, built-in functions and types, and receivers whose calls say nothing about a flow (fixed values).
STDLIB = "fmt json strconv time errors strings sort sync io bytes math os log slog context net http reflect unicode filepath path regexp bufio runtime".split()
BUILTINS = (
    "make len append cap new delete copy close panic recover print println int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 string bool float32 float64 byte rune error"
).split()
NOISE = rf"^(?:{'|'.join(BUILTINS)})$|^(?:{'|'.join(STDLIB)})\.|^(?:w|ctx|err)\.|^r\.(?:URL|Context|Body|Header|PathValue|Method|Form)"


def without_noise(calls: DataFrame, callee: str) -> DataFrame:
    """Calls without built-ins, the standard library and request plumbing."""
    return calls.where(~F.coalesce(F.col(callee).rlike(NOISE), F.lit(False)))


def call_confidence(kind: Column) -> Column:
    """Interface calls are surer than direct ones by type; indirect ones least (0.8, 0.7, 0.4)."""
    return F.when(kind == "interface", 0.8).when(kind == "direct", 0.7).otherwise(0.4)


def merge_lists(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values) of rows (keys, ordinal, value): every value at its last ordinal, without those whose last word is !value."""
    negated = F.startswith("value", F.lit("!"))
    rows = parts.where(F.col("value").isNotNull()).withColumns({"on": ~negated, "v": F.when(negated, F.expr("substring(value, 2)")).otherwise(F.col("value"))})
    last = rows.groupBy(*keys, "v").agg(F.max_by("on", F.struct("ordinal", "on")).alias("on"), F.min("ordinal").alias("first"))
    kept = last.where("on").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "v"))).alias("x"))
    return kept.select(*keys, F.transform("x", lambda x: x["v"]).alias("values"))


def path_forest(paths: DataFrame, path: str = "path") -> DataFrame:
    """(node, parent, real): paths under their nearest ancestor that is one of them or branches; other ancestors are passed over."""
    real = paths.select(F.col(path).alias("node")).where(F.col(path) != "").distinct()
    p = F.split("node", "/")
    above = real.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, 1, k), "/"))).alias("a"))
    step = above.select("a", F.element_at(F.split(F.substring(F.col("node"), F.length("a") + 2, F.length("node")), "/"), 1).alias("child")).where(F.col("child") != "")
    branching = step.groupBy("a").agg(F.countDistinct("child").alias("n")).where(F.col("n") >= 2).select(F.col("a").alias("node"))
    nodes = real.withColumn("real", F.lit(True)).unionByName(branching.join(real, "node", "left_anti").withColumn("real", F.lit(False)))
    q = F.split("node", "/")
    ups = nodes.select("node", "real", F.explode_outer(F.when(F.size(q) > 1, F.transform(F.sequence(F.lit(1), F.size(q) - 1), lambda k: F.array_join(F.slice(q, 1, k), "/")))).alias("a"))
    known = nodes.select(F.col("node").alias("a"), F.lit(True).alias("there"))
    best = ups.join(known, "a", "left").groupBy("node", "real").agg(F.max_by("a", F.when(F.col("there"), F.length("a"))).alias("parent"))
    return best.select("node", "parent", "real")


#: Names one summary takes (fixed value).
ENTITIES = 20


def cognitive_summary(names: list[str], entities: DataFrame, es: DataFrame, covered: DataFrame, risks: DataFrame) -> DataFrame:
    """For up to ENTITIES named entities (more are refused) their degrees, coverage and risk; what is not known stays null.

    `covered` has (key, score), `risks` (scope_key, path, risk_score). A name
    that no entity has gives a row with `found` false.
    """
    names = list(dict.fromkeys(names))
    if len(names) > ENTITIES:
        raise ValueError(f"{len(names)} names, of which {ENTITIES} are allowed at most")
    wanted = entities.sparkSession.createDataFrame([(n,) for n in names], "name string")
    e = entities.where(F.col("name").isin(names)).select("name", "key", "scope_key", F.col("source_location.file").alias("path"))
    d = degrees(es.join(F.broadcast(e.select(F.col("key").alias("src"))), "src", "left_semi").unionByName(es.join(F.broadcast(e.select(F.col("key").alias("dst"))), "dst", "left_semi").select(es.columns)).dropDuplicates(["id"]))
    rows = e.join(d, "key", "left").join(covered.select("key", "score"), "key", "left").join(risks, ["scope_key", "path"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = F.broadcast(wanted).join(rows, "name", "left")
    return out.select("name", F.col("key").isNotNull().alias("found"), "key", F.when(F.col("key").isNotNull(), zero("in_degree")).alias("in_degree"), F.when(F.col("key").isNotNull(), zero("out_degree")).alias("out_degree"), "score", "risk_score")


# --- queries -----------------------------------------------------------------

_DECL = " UNION ALL ".join(
    f"SELECT doc_id, '{lang}' AS language, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS name, unnest(regexp_extract_all(text, '{p}', 2)) AS other FROM documents"
    for lang, kind, p in DECLARATIONS
)


@query(f"SELECT doc_id, language, kind, name, coalesce(other, '') AS other FROM ({_DECL})")
def extracted_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Declarations in the corpus' texts by declarative rules."""
    return declarations(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("file", "doc_id")


_REL_SQL = " UNION ALL ".join(
    [f"SELECT doc_id, '{k}' AS rel_type, a AS source, unnest(regexp_split_to_array(regexp_replace(regexp_replace(b, '<[^<>]*>', '', 'g'), '\\b(?:public|protected|private)\\s+', '', 'g'), '\\s*,\\s*')) AS target"
     f" FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS a, unnest(regexp_extract_all(text, '{p}', 2)) AS b FROM documents)" for k, p in SUPERTYPES]
    + [f"SELECT doc_id, '{k}', unnest(regexp_extract_all(text, '{p}', {s})), unnest(regexp_extract_all(text, '{p}', {3 - s})) FROM documents" for k, p, s in ARROWS]
)


@query(f"SELECT DISTINCT doc_id, rel_type, source, target FROM ({_REL_SQL}) WHERE trim(target) <> ''")
def extracted_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations that the corpus' texts declare or draw."""
    return text_relations(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("file", "doc_id")


_GROUPS = [("^src/core/", "core", 5), ("^src/(api|cli)/", "surface", 3), ("^src/", "source", 1), (r"\.go$", "go", 3)]


@query(f"""WITH {ENT}, g AS (SELECT key, source_location.file AS file, CASE WHEN regexp_matches(source_location.file, '^src/core/') THEN 'core' WHEN regexp_matches(source_location.file, '^src/(api|cli)/') THEN 'surface'
      WHEN regexp_matches(source_location.file, '\\.go$') THEN 'go' WHEN regexp_matches(source_location.file, '^src/') THEN 'source' ELSE 'other' END AS grp FROM ent) SELECT grp, count(*) AS entities FROM g GROUP BY 1""")
def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the grouping rule of the highest priority."""
    e = current_entities(spark, d, "source_location").select("key", F.col("source_location.file").alias("file"))
    return groups(e, _GROUPS).groupBy("grp").agg(F.count(F.lit(1)).alias("entities"))


@query(f"""WITH {ENT}, g AS (SELECT key, CASE WHEN contains(source_location.file, '/') THEN regexp_replace(source_location.file, '/[^/]*$', '') ELSE '.' END AS dir FROM ent WHERE source_location.file IS NOT NULL),
      s AS (SELECT dir FROM g GROUP BY 1 ORDER BY count(*) DESC, dir LIMIT 10) SELECT dir, key, rn AS member_rank FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY key) AS rn FROM g WHERE dir IN (SELECT dir FROM s)) WHERE rn <= 5""")
def largest_directories(spark: SparkSession, d: str) -> DataFrame:
    """The 10 largest directories with their first 5 entities."""
    e = current_entities(spark, d, "source_location").where(F.col("source_location.file").isNotNull()).select("key", dirname(F.col("source_location.file")).alias("dir"))
    return limited(e, 10, 5, "dir", "key")


@query(f"""WITH {ENT}, {REL}, sh AS (SELECT string_split(key, '.')[-1] AS short, min(key) AS repaired FROM ent GROUP BY 1)
    SELECT id, CASE WHEN target IN (SELECT key FROM ent) THEN target ELSE coalesce(repaired, target) END AS target FROM rel LEFT JOIN sh ON sh.short = string_split(target, '.')[-1] WHERE rel_type = 'inheritance'""")
def repaired_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Inheritance with targets repaired by their simple name."""
    r = relations(spark, d, "rel_type").where(F.col("rel_type") == "inheritance").select("id", "target")
    return repair_targets(r, current_entities(spark, d, "id"))


@query(f"""WITH {ENT}, p AS (SELECT key, array_to_string(string_split(key, '.')[1:2], '.') AS package, unnest(range(1, len(string_split(key, '.')))) AS k FROM ent)
    SELECT module, arg_min(package, key) AS package FROM (SELECT key, package, array_to_string(string_split(key, '.')[1:k], '.') AS module FROM p) GROUP BY 1""")
def module_package_map(spark: SparkSession, d: str) -> DataFrame:
    """Every dotted prefix with the package of its first entity."""
    e = current_entities(spark, d, "id").select("key", F.array_join(F.slice(F.split("key", r"\."), 1, 2), ".").alias("package"))
    return module_packages(e)


@query(f"""WITH {ENT}, f AS (SELECT scope_key, name, arg_min(key, (first_seen_at, key)) AS key FROM ent WHERE name IS NOT NULL AND first_seen_at IS NOT NULL GROUP BY 1, 2) SELECT * FROM f""")
def qualified_names(spark: SparkSession, d: str) -> DataFrame:
    """The first entity of every name of a scope."""
    e = current_entities(spark, d, "scope_key", "name", "first_seen_at").where(F.col("first_seen_at").isNotNull())
    return first_by_name(e, ["scope_key"], "name", "key", "first_seen_at")


#: A project's own conventions, as a user declares them.
_CUSTOM = {"readers": [(None, "Session", None, "session", None, 1), ("emitToken", None, None, "token", None, 1)], "writers": [(None, "Order", None, "order", None, 1)]}


@query(f"""WITH {EDGE} SELECT framework, protocol, count(*) AS calls FROM (SELECT CASE WHEN target_method LIKE '%Server' THEN 'grpc' WHEN target_method LIKE '%Session' OR target_method = 'emitToken' THEN 'readers'
      WHEN target_method LIKE '%Order' THEN 'writers' END AS framework, CASE WHEN target_method LIKE '%Server' THEN 'grpc' WHEN target_method LIKE '%Session' THEN 'session' WHEN target_method = 'emitToken' THEN 'token'
      WHEN target_method LIKE '%Order' THEN 'order' END AS protocol FROM edge WHERE rel_type = 'call') WHERE protocol IS NOT NULL GROUP BY 1, 2""")
def call_protocols(spark: SparkSession, d: str) -> DataFrame:
    """Calls that register an entry point, by framework and protocol, under a project's own patterns beside grpc's."""
    calls = edges(spark, d, "target_method").where(F.col("rel_type") == "call").select(
        F.col("target_method").alias("function"), F.lit(None).cast("string").alias("receiver_type"), F.array().cast("array<string>").alias("args")
    )
    return entry_points(calls, ["grpc"], _CUSTOM).groupBy("framework", "protocol").agg(F.count(F.lit(1)).alias("calls"))


@query(f"""WITH {EDGE} SELECT call_type, CASE call_type WHEN 'interface' THEN 0.8::DOUBLE WHEN 'direct' THEN 0.7 ELSE 0.4 END AS confidence, count(*) AS calls FROM edge
    WHERE rel_type = 'call' AND NOT coalesce(regexp_matches(target_method, '{NOISE}'), false) GROUP BY 1, 2""")
def call_types(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a flow by type, with the confidence a type has."""
    calls = without_noise(edges(spark, d, "target_method", "call_type").where(F.col("rel_type") == "call"), "target_method")
    return calls.groupBy("call_type", call_confidence(F.col("call_type")).alias("confidence")).agg(F.count(F.lit(1)).alias("calls"))


@query()
def directory_forest(spark: SparkSession, d: str) -> DataFrame:
    """The files of the entities as a forest of branching directories."""
    return path_forest(current_entities(spark, d, "source_location").select(F.col("source_location.file").alias("path")).distinct())


@query()
def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Cognitive summaries of a few entities and of a name that nobody has."""
    from strataspark.operators.coverage import entity_scores
    from strataspark.operators.history import _c, file_risk

    e = current_entities(spark, d, "name", "scope_key", "source_location")
    risks = file_risk(_c(spark, d)).select("scope_key", "path", "risk_score")
    return cognitive_summary(["FlowLoader0", "SessionPlanner3", "NobodyKnows"], e, edges(spark, d, "rel_type"), entity_scores(spark, d), risks)
