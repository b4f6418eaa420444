"""Graphs of Go projects: packages, capabilities, goroutines and call chains of raw records, and implicit interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators import flatten
from strataspark.plans.parallel import spread
from strataspark.plans.registry import register
from strataspark.plans.storage import cut
from strataspark.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

#: Limits from which a package has too much of something (fixed values); 0 switches a limit off.
GOD_LIMITS = {"fan_in": 5, "structs": 20, "functions": 50, "file_count": 20}

# --- operators ---------------------------------------------------------------


def layer(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The objects of one kind, redelivered records once."""
    return flatten.flat(spread(table(spark, root, "raw_docs").select("raw_id", "payload")), kind).distinct()


def fans(nodes: DataFrame, edges: DataFrame, distinct: bool = False) -> DataFrame:
    """Nodes with fan_in and fan_out: numbers of edges, or of different neighbours."""
    e = edges.select("raw_id", "source", "target")
    e = e.distinct() if distinct else e
    i = e.groupBy("raw_id", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    o = e.groupBy("raw_id", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    out = nodes.join(i, ["raw_id", "id"], "left").join(o, ["raw_id", "id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "fan_out")})


def too_big(limits: dict[str, int] = GOD_LIMITS) -> Column:
    """The limits that a package with its fans reaches, as an array of names; a missing figure reaches none."""
    tests = [F.when(F.col(c) >= n, F.lit(c)) for c, n in limits.items() if n > 0]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def implicit_implementations(structs: DataFrame, interfaces: DataFrame, methods: DataFrame) -> DataFrame:
    """(raw_id, struct, interface): structs with all methods of an interface by name; an interface without methods matches none.

    A division by a join on the method's name and a count, without pairing every struct with every interface.
    """
    m = methods.select("raw_id", F.col("parent_path").alias("path"), "name").where(F.col("name").isNotNull()).distinct()
    of = lambda df, c: df.select("raw_id", "path", F.col("name").alias(c)).join(m, ["raw_id", "path"])
    s = of(structs, "struct").select("raw_id", F.col("path").alias("s_path"), "struct", "name")
    i = of(interfaces, "interface").select("raw_id", F.col("path").alias("i_path"), "interface", "name")
    need = i.groupBy("raw_id", "i_path").agg(F.count(F.lit(1)).alias("need"))
    have = s.join(i, ["raw_id", "name"]).groupBy("raw_id", "s_path", "i_path", "struct", "interface").agg(F.count(F.lit(1)).alias("have"))
    return have.join(need, ["raw_id", "i_path"]).where(F.col("have") == F.col("need")).select("raw_id", "s_path", "i_path", "struct", "interface")


def call_paths(chains: DataFrame, calls: DataFrame, depth: int = 3) -> DataFrame:
    """(raw_id, chain, entry_point, target, depth): what a chain's calls reach from its first caller, level by level, to `depth`."""
    edges = calls.select("raw_id", F.col("parent_path").alias("chain"), "source", "target").distinct()
    first = calls.where(F.endswith("path", F.lit(".0"))).select("raw_id", F.col("parent_path").alias("chain"), F.col("source").alias("target")).distinct()
    seen = frontier = first.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        step = frontier.select("raw_id", "chain", F.col("target").alias("source")).join(edges, ["raw_id", "chain", "source"])
        step = step.select("raw_id", "chain", "target").distinct().withColumn("depth", F.lit(level))
        frontier = step.join(seen.select("raw_id", "chain", "target"), ["raw_id", "chain", "target"], "left_anti")
        seen = seen.unionByName(frontier)
    names = chains.select("raw_id", F.col("path").alias("chain"), "entry_point").distinct()
    return seen.where(F.col("depth") > 0).join(names, ["raw_id", "chain"]).select("raw_id", "chain", "entry_point", "target", "depth")


# --- queries -----------------------------------------------------------------

# The JSON objects of payloads, and lists in them, as SQL.
_JS = r"""js0 AS (SELECT DISTINCT raw_id, CASE WHEN starts_with(payload, chr(65279)) THEN substr(payload, 2) ELSE payload END AS p FROM raw_docs),
  js1 AS (SELECT raw_id, CASE WHEN json_valid(p) THEN CASE WHEN json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') ELSE p END END AS p FROM js0),
  js2 AS (SELECT raw_id, CASE WHEN starts_with(p, chr(65279)) THEN substr(p, 2) ELSE p END AS p FROM js1),
  js AS (SELECT raw_id, p::JSON AS j FROM js2 WHERE json_valid(p) AND json_type(p) = 'OBJECT')"""
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'OBJECT' THEN [{0}] END"


def _top(name: str, at: str) -> str:
    return f"""{name} AS (SELECT raw_id, (k - 1)::VARCHAR AS path, l[k] AS n FROM (SELECT raw_id, l, unnest(range(1, len(l) + 1)) AS k FROM
      (SELECT raw_id, {_LIST.format('v')} AS l FROM (SELECT raw_id, json_extract(j, '$.{at}') AS v FROM js))) WHERE json_type(l[k]) = 'OBJECT')"""


def _child(name: str, above: str, field: str) -> str:
    return f"""{name} AS (SELECT raw_id, pp || '.' || (k - 1)::VARCHAR AS path, pp AS parent_path, l[k] AS n FROM (SELECT raw_id, pp, l, unnest(range(1, len(l) + 1)) AS k FROM
      (SELECT raw_id, path AS pp, {_LIST.format('v')} AS l FROM (SELECT raw_id, path, json_extract(n, '$.{field}') AS v FROM {above}))) WHERE json_type(l[k]) = 'OBJECT')"""


_AT = "extensions.goAtlas.layers"
TREE = ", ".join(
    [
        _JS, _top("entity", "entities"), _child("method", "entity", "methods"), _child("param", "method", "params"), _child("outgoing", "entity", "outgoing"),
        _top("package_node", f"{_AT}.package.nodes"), _top("package_edge", f"{_AT}.package.edges"), _top("capability_node", f"{_AT}.capability.nodes"),
        _top("goroutine_node", f"{_AT}.goroutine.nodes"), _top("call_chain", f"{_AT}.flow.callChains"), _child("call_edge", "call_chain", "calls"),
    ]
)
_S = "json_extract_string(n, '$.{}')"


_N = f"pn AS (SELECT DISTINCT raw_id, path, {_S.format('id')} AS id, {_S.format('name')} AS name, {_S.format('fileCount')}::BIGINT AS file_count, {_S.format('stats.structs')}::BIGINT AS structs, {_S.format('stats.functions')}::BIGINT AS functions FROM package_node)"
_E = f"pe AS (SELECT DISTINCT raw_id, path, {_S.format('source')} AS source, {_S.format('target')} AS target, {_S.format('strength')}::BIGINT AS strength FROM package_edge)"
_F = """fi AS (SELECT raw_id, target AS id, count(*) AS fan_in FROM pe GROUP BY 1, 2), fo AS (SELECT raw_id, source AS id, count(*) AS fan_out FROM pe GROUP BY 1, 2),
  fan AS (SELECT pn.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM pn LEFT JOIN fi USING (raw_id, id) LEFT JOIN fo USING (raw_id, id))"""


@query(f"WITH {TREE}, {_N}, {_E}, {_F} SELECT raw_id, path, id, fan_in, fan_out FROM fan")
def layer_package_fan(spark: SparkSession, d: str) -> DataFrame:
    """Packages with the numbers of their edges in and out."""
    return fans(layer(spark, d, "package_node"), layer(spark, d, "package_edge")).select("raw_id", "path", "id", "fan_in", "fan_out")


@query(f"WITH {TREE}, {_N}, {_E}, {_F} SELECT raw_id, path, id, fan_in FROM fan WHERE fan_in >= 1 ORDER BY fan_in DESC, raw_id, id, path LIMIT 20")
def layer_fan_in_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The 20 packages with the largest fan-in."""
    f = fans(layer(spark, d, "package_node"), layer(spark, d, "package_edge")).where(F.col("fan_in") >= 1)
    return f.orderBy(F.desc("fan_in"), "raw_id", "id", "path").limit(20).select("raw_id", "path", "id", "fan_in")


@query(f"""WITH {TREE}, {_N}, {_E}, {_F} SELECT * FROM (SELECT raw_id, path, id, concat_ws(',', CASE WHEN fan_in >= 5 THEN 'fan_in' END, CASE WHEN structs >= 20 THEN 'structs' END,
    CASE WHEN functions >= 50 THEN 'functions' END, CASE WHEN file_count >= 20 THEN 'file_count' END) AS reasons FROM fan) WHERE reasons <> ''""")
def layer_god_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages that reach a limit, with the limits reached."""
    f = fans(layer(spark, d, "package_node"), layer(spark, d, "package_edge")).withColumn("r", too_big())
    return f.where(F.size("r") > 0).select("raw_id", "path", "id", F.array_join("r", ",").alias("reasons"))


@query(f"""WITH {TREE}, {_N}, {_E}, u AS (SELECT DISTINCT raw_id, source, target FROM pe WHERE source <> target), i AS (SELECT raw_id, target AS id, count(*) AS n FROM u GROUP BY 1, 2)
    SELECT raw_id, id, coalesce(n, 0) AS in_degree, row_number() OVER (PARTITION BY raw_id ORDER BY coalesce(n, 0) DESC, id) AS rank FROM (SELECT DISTINCT raw_id, id FROM pn WHERE id IS NOT NULL) LEFT JOIN i USING (raw_id, id)""")
def layer_package_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Packages of every record by different packages that depend on them."""
    from pyspark.sql import Window

    nodes = layer(spark, d, "package_node").where(F.col("id").isNotNull()).select("raw_id", "id").distinct()
    e = layer(spark, d, "package_edge").where(F.col("source") != F.col("target"))
    f = fans(nodes, e, distinct=True).withColumnRenamed("fan_in", "in_degree")
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("raw_id").orderBy(F.desc("in_degree"), "id"))).drop("fan_out")


@query(f"""WITH {TREE}, {_N}, {_E}, nm AS (SELECT raw_id, id, min(name) AS name FROM pn GROUP BY 1, 2)
    SELECT pe.raw_id, pe.path, coalesce(a.name, source) AS source, coalesce(b.name, target) AS target, strength, CASE WHEN strength >= 10 THEN 'thick' WHEN strength >= 3 THEN 'medium' ELSE 'thin' END AS arrow
    FROM pe LEFT JOIN nm a ON a.raw_id = pe.raw_id AND a.id = source LEFT JOIN nm b ON b.raw_id = pe.raw_id AND b.id = target""")
def layer_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Package edges by the names of their ends, with the style of their arrow."""
    names = layer(spark, d, "package_node").groupBy("raw_id", "id").agg(F.min("name").alias("name"))
    e = layer(spark, d, "package_edge").select("raw_id", "path", "source", "target", "strength")
    end = lambda c: names.select("raw_id", F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    e = e.join(end("source"), ["raw_id", "source"], "left").join(end("target"), ["raw_id", "target"], "left")
    arrow = F.when(F.col("strength") >= 10, "thick").when(F.col("strength") >= 3, "medium").otherwise("thin")
    return e.select(
        "raw_id", "path", F.coalesce("source_name", "source").alias("source"), F.coalesce("target_name", "target").alias("target"), "strength", arrow.alias("arrow")
    )


@query(f"WITH {TREE} SELECT package, type AS node_type, count(*) AS nodes, count(DISTINCT id) AS ids FROM (SELECT DISTINCT raw_id, path, {_S.format('package')} AS package, {_S.format('type')} AS type, {_S.format('id')} AS id FROM capability_node) GROUP BY 1, 2")
def layer_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """Capability nodes by package and type."""
    return layer(spark, d, "capability_node").groupBy("package", "node_type").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("id").alias("ids"))


@query(f"WITH {TREE} SELECT package, count(*) AS nodes, count(*) FILTER (WHERE type = 'spawned') AS spawned FROM (SELECT DISTINCT raw_id, path, {_S.format('package')} AS package, {_S.format('type')} AS type FROM goroutine_node) GROUP BY 1")
def layer_goroutines(spark: SparkSession, d: str) -> DataFrame:
    """Goroutines by package, and how many of them are spawned."""
    return layer(spark, d, "goroutine_node").groupBy("package").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "spawned").alias("spawned"))


_CE = f"ce AS (SELECT DISTINCT raw_id, path, parent_path, {_S.format('from')} AS source, {_S.format('to')} AS target, {_S.format('type')} AS type, {_S.format('confidence')}::DOUBLE AS confidence FROM call_edge)"


@query(f"WITH {TREE}, {_CE} SELECT type AS call_type, count(*) AS calls, round(avg(confidence), 6) AS confidence FROM ce GROUP BY 1")
def layer_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of chains by type with their mean confidence."""
    c = layer(spark, d, "call_edge")
    return c.groupBy("call_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"""WITH RECURSIVE {TREE}, {_CE}, walk(raw_id, chain, target, depth) AS (SELECT raw_id, parent_path, source, 0 FROM ce WHERE ends_with(path, '.0')
      UNION SELECT w.raw_id, w.chain, ce.target, w.depth + 1 FROM walk w JOIN ce ON ce.raw_id = w.raw_id AND ce.parent_path = w.chain AND ce.source = w.target WHERE w.depth < 3),
      best AS (SELECT raw_id, chain, target, min(depth) AS depth FROM walk GROUP BY 1, 2, 3), ch AS (SELECT DISTINCT raw_id, path AS chain, {_S.format('entryPoint')} AS entry_point FROM call_chain)
    SELECT raw_id, chain, entry_point, target, depth FROM best JOIN ch USING (raw_id, chain) WHERE depth > 0""")
def layer_call_paths(spark: SparkSession, d: str) -> DataFrame:
    """What every call chain reaches within 3 calls."""
    return call_paths(layer(spark, d, "call_chain"), layer(spark, d, "call_edge"))


@query(f"""WITH {TREE}, m AS (SELECT DISTINCT raw_id, parent_path AS path, {_S.format('name')} AS name FROM method WHERE {_S.format('name')} IS NOT NULL),
      x AS (SELECT DISTINCT raw_id, path, {_S.format('name')} AS ename, {_S.format('type')} AS type FROM entity),
      s AS (SELECT x.raw_id, x.path, ename, m.name FROM x JOIN m USING (raw_id, path) WHERE type IN ('struct', 'class')), i AS (SELECT x.raw_id, x.path, ename, m.name FROM x JOIN m USING (raw_id, path) WHERE type = 'interface'),
      need AS (SELECT raw_id, path, count(*) AS need FROM i GROUP BY 1, 2)
    SELECT h.raw_id, s_path, i_path, struct, interface FROM (SELECT s.raw_id, s.path AS s_path, i.path AS i_path, s.ename AS struct, i.ename AS interface, count(*) AS have FROM s JOIN i ON s.raw_id = i.raw_id AND s.name = i.name GROUP BY 1, 2, 3, 4, 5) h
    JOIN need ON need.raw_id = h.raw_id AND need.path = i_path WHERE have = need""")
def implicit_interfaces(spark: SparkSession, d: str) -> DataFrame:
    """Structs and classes of a record with all methods of one of its interfaces."""
    e = layer(spark, d, "entity")
    return implicit_implementations(e.where(F.col("entity_type").isin("struct", "class")), e.where(F.col("entity_type") == "interface"), layer(spark, d, "method"))


# --- methods that come by embedding, and uses of concrete types ---------------


def promoted_methods(own: DataFrame, embeds: DataFrame) -> DataFrame:
    """(type, method, level, by_value): method sets with embedding; `level` counts the embeddings a method has come through.

    `own` has (type, method) and, if known, `pointer`, whether the receiver is
    one; `embeds` (type, embedded) and, if known, `pointer`. A type's own
    method hides those of its embedded types; a method that several of them
    have is ambiguous and left out. Every method is in the set of pointers to a
    type; by_value tells whether it is in that of values too, to which
    pointer receivers and pointer embeddings do not lead. Types from which an
    embedding cycle can be reached promote nothing.
    """
    from strataspark.operators.graph import components

    flag = lambda df: F.coalesce(F.col("pointer"), F.lit(False)) if "pointer" in df.columns else F.lit(False)
    pairs = embeds.where(F.col("type").isNotNull() & F.col("embedded").isNotNull()).groupBy("type", "embedded").agg(F.max(flag(embeds)).alias("by_pointer"))
    ends = pairs.select(F.col("type").alias("src"), F.col("embedded").alias("dst"))
    barred = cut(components(ends).select(F.col("key").alias("type")).unionByName(ends.where(F.col("src") == F.col("dst")).select(F.col("src").alias("type"))).distinct())
    while True:  # what embeds a barred type is barred
        more = pairs.join(barred.withColumnRenamed("type", "embedded"), "embedded", "left_semi").select("type").distinct().join(barred, "type", "left_anti")
        if more.isEmpty():
            break
        barred = cut(barred.unionByName(more))
    pairs = cut(pairs.join(barred, "type", "left_anti"))
    mine = own.where(F.col("method").isNotNull()).groupBy("type", "method").agg(F.max(~flag(own)).alias("by_value")).withColumn("level", F.lit(0))
    mine = cut(mine.select("type", "method", "level", "by_value"))
    sets = mine
    while True:  # after n rounds the sets of all types with at most n embeddings below them are final
        offered = pairs.join(sets.withColumnRenamed("type", "embedded"), "embedded")
        once = offered.groupBy("type", "method").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("level") + 1).alias("level"), F.max(F.col("by_value") & ~F.col("by_pointer")).alias("by_value"))
        promoted = once.where(F.col("n") == 1).drop("n").join(mine.select("type", "method"), ["type", "method"], "left_anti")
        now = cut(mine.unionByName(promoted.select("type", "method", "level", "by_value")))
        if now.count() == sets.count() and now.exceptAll(sets).isEmpty():
            return now
        sets = now


def embedded_implementations(sets: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(type, interface): types whose method set, promoted methods included, has all of an interface's methods by name; `interfaces` has (interface, method). One without methods matches none."""
    i = interfaces.where(F.col("method").isNotNull()).select("interface", "method").distinct()
    need = i.groupBy("interface").agg(F.count(F.lit(1)).alias("need"))
    have = sets.select("type", "method").distinct().join(i, "method").groupBy("type", "interface").agg(F.count(F.lit(1)).alias("have"))
    return have.join(need, "interface").where(F.col("have") == F.col("need")).select("type", "interface")


def field_uses(fields: DataFrame, imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(owner, target): what the types of fields refer to.

    `fields` has (owner, package, type_text), `imports` (package, alias, path),
    `nodes` (id, package, name). Pointers, slices and maps are stripped; a
    qualified name goes through the package's import of that alias, else an
    import whose path ends in it; a bare name stays in the package.
    """
    bare = F.regexp_replace("type_text", r"^(?:\*|\[\d*\]|map\[[^\]]*\]|chan\s+|<-)+", "")
    f = fields.select("owner", "package", F.regexp_extract(bare, r"^(?:(\w+)\.)?(\w+)", 1).alias("qualifier"), F.regexp_extract(bare, r"^(?:(\w+)\.)?(\w+)", 2).alias("name"))
    i = imports.select("package", F.coalesce("alias", F.element_at(F.split("path", "/"), -1)).alias("qualifier"), "path").distinct()
    first = i.groupBy("package", "qualifier").agg(F.min("path").alias("path"))
    r = f.join(first, ["package", "qualifier"], "left")
    home = F.when(F.col("qualifier") == "", F.col("package")).otherwise(F.col("path"))
    r = r.select("owner", home.alias("package"), "name").where(F.col("package").isNotNull())
    return r.join(nodes.select(F.col("id").alias("target"), "package", "name"), ["package", "name"]).select("owner", "target").distinct()


def concrete_risks(uses: DataFrame, nodes: DataFrame) -> DataFrame:
    """Uses of concrete types of other packages: (owner, target, from_package, to_package). `nodes` has (id, package, node_type)."""
    a = nodes.select(F.col("id").alias("owner"), F.col("package").alias("from_package"))
    b = nodes.select(F.col("id").alias("target"), F.col("package").alias("to_package"), "node_type")
    return uses.join(a, "owner").join(b, "target").where((F.col("from_package") != F.col("to_package")) & (F.col("node_type") != "interface")).select("owner", "target", "from_package", "to_package")


def hotspots(nodes: DataFrame) -> DataFrame:
    """Nodes with more than 10 methods or a fan-in over 5; missing figures are none."""
    return nodes.where((F.coalesce("methods", F.lit(0)) > 10) | (F.coalesce("fan_in", F.lit(0)) > 5))


def lifecycles(spawns: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, has_context, has_cancel, orphan) of goroutines: whether what they run takes a context or can be stopped.

    `spawns` has (id, target), `functions` (name, params ARRAY, body). A target
    that is not known is no orphan: nothing can be said of it.
    """
    context = F.coalesce(F.exists("params", lambda p: F.contains(p, F.lit("context.Context"))), F.lit(False))
    stop = F.coalesce(F.col("body").rlike(r"(?i)ctx\.Done\(|<-\s*[\w.]*(?:done|stop|quit|exit|cancel)\w*"), F.lit(False))
    f = functions.groupBy(F.col("name").alias("target")).agg(F.max(context).alias("has_context"), F.max(stop).alias("has_cancel"))
    j = spawns.select("id", "target").join(f, "target", "left")
    orphan = F.coalesce(~F.col("has_context") & ~F.col("has_cancel"), F.lit(False))
    return j.select("id", F.coalesce("has_context", F.lit(False)).alias("has_context"), F.coalesce("has_cancel", F.lit(False)).alias("has_cancel"), orphan.alias("orphan"))
