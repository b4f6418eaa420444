"""Traversal, cycles and degrees of the code graph.

The only loops on the driver are those over levels and rounds; every step is a
distributed job over (vertex, ...) rows, written to the checkpoint folder where
the next step would otherwise recompute all steps before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import package_name, plain
from strataspark.plans.registry import register
from strataspark.plans.storage import cut
from strataspark.sources.graph import EDGE, ENT, REL, edges, relations
from strataspark.sources.tables import current_entities, table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

MAX_DEPTH = 5


def clamp(depth: int) -> int:
    """Depths lie in 1..5."""
    return max(1, min(MAX_DEPTH, depth))


# --- operators ---------------------------------------------------------------


def reachable(pairs: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(key, depth): vertices within `depth` steps of any start along (src, dst) pairs, at their least depth, without the starts.

    Starts with a null key reach nothing; cycles end by themselves.
    """
    pairs = cut(pairs.select("src", "dst").distinct())  # every level reads them again
    begun = starts.select("key").where(F.col("key").isNotNull()).distinct().withColumn("depth", F.lit(0))
    seen, frontier = begun, begun
    for level in range(1, clamp(depth) + 1):
        step = frontier.join(pairs, frontier["key"] == pairs["src"]).select(F.col("dst").alias("key")).distinct()
        frontier = cut(step.join(seen.select("key"), "key", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") > 0)


def callers(calls: DataFrame, targets: DataFrame, depth: int, method: str | None = None) -> DataFrame:
    """(source, source_method, depth): who calls the targets, level by level.

    A method name limits the first level only. The same caller can come again
    on a deeper level, once per level and method.
    """
    calls = cut(calls.select("src", "dst", "source_method", "target_method").distinct())  # every level reads them again
    frontier = targets.select(F.col("key").alias("dst")).distinct()
    out = None
    for level in range(1, clamp(depth) + 1):
        hits = calls.join(frontier, "dst")
        if level == 1 and method is not None:
            hits = hits.where(F.col("target_method") == method)
        found = cut(hits.select(F.col("src").alias("source"), "source_method").distinct().withColumn("depth", F.lit(level)))
        out = found if out is None else out.unionByName(found)
        if found.isEmpty():
            break
        frontier = found.select(F.col("source").alias("dst")).distinct()
    return out


#: Steps of a round between two writes to the checkpoint folder: fewer jobs, plans of a bounded length.
STEPS = 3


def _trim(pairs: DataFrame) -> DataFrame:
    """Pairs whose ends both have an edge in and an edge out, over and over: what is left holds all cycles."""
    n = pairs.count()
    while n:
        for _ in range(2):
            inside = (
                pairs.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i"))
                .unionByName(pairs.select(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
                .groupBy("v")
                .agg(F.max("o").alias("o"), F.max("i").alias("i"))
                .where((F.col("o") == 1) & (F.col("i") == 1))
                .select("v")
            )
            pairs = (
                pairs.join(inside.withColumnRenamed("v", "src"), "src", "left_semi")
                .join(inside.withColumnRenamed("v", "dst"), "dst", "left_semi")
                .select("src", "dst")
            )
        pairs = cut(pairs)
        left = pairs.count()
        if left == n:
            break
        n = left
    return pairs


def _spread(pairs: DataFrame, colors: DataFrame) -> DataFrame:
    """(v, color): the least color that reaches a vertex, by rounds of taking the least of the vertices before it."""
    while True:
        new = colors.select("v", "color", F.col("color").alias("before"))
        for _ in range(STEPS):
            told = pairs.join(new, pairs["src"] == new["v"]).select(F.col("dst").alias("v"), "color", F.lit(None).cast("string").alias("before"))
            new = new.unionByName(told).groupBy("v").agg(F.min("color").alias("color"), F.max("before").alias("before"))
        new = cut(new)
        if new.where(F.col("color") != F.col("before")).isEmpty():
            return new.select("v", "color")
        colors = new.select("v", "color")


def _confirm(inside: DataFrame) -> DataFrame:
    """(v, color): the vertices of a color from which its root, the vertex of the color's own name, can be reached inside it."""
    member = inside.select(F.col("color").alias("v"), F.col("color")).distinct().withColumn("new", F.lit(0))
    while True:
        grown = member.withColumn("new", F.lit(0))
        for _ in range(STEPS):
            back = inside.join(grown.select(F.col("v").alias("dst"), "color"), ["dst", "color"])
            back = back.select(F.col("src").alias("v"), "color", F.lit(1).alias("new"))
            grown = grown.unionByName(back).groupBy("v", "color").agg(F.min("new").alias("new"))
        member = cut(grown)
        if member.where(F.col("new") == 1).isEmpty():
            return member.select("v", "color")


#: Edges that one task takes whole (some 100 MB); a larger rest is worked on in rounds.
LOCAL_EDGES = 500_000


def _local_components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected components of all edges of the task by one depth-first pass with low links, without recursion."""
    after: dict[str, list[str]] = {}
    for b in batches:
        for a, c in zip(b["src"], b["dst"]):
            after.setdefault(a, []).append(c)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    place: dict[str, int] = {}  # where a vertex lies on the path
    open_, path, rows = set(), [], []
    for root in after:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        open_.add(root)
        place[root] = len(path)
        path.append(root)
        work = [(root, iter(after[root]))]
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    members = path[place[v] :]
                    del path[place[v] :]
                    open_.difference_update(members)
                    if len(members) > 1:
                        least = min(members)
                        rows += [(m, least) for m in members]
            elif w not in order:
                order[w] = low[w] = len(order)
                open_.add(w)
                place[w] = len(path)
                path.append(w)
                work.append((w, iter(after.get(w, ()))))
            elif w in open_:
                low[v] = min(low[v], order[w])
    if rows:
        yield pd.DataFrame(rows, columns=["key", "component"])


def components(pairs: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(key, component): vertices on a cycle with the least vertex of their strongly connected component; self loops are none.

    Vertices that are on no cycle are trimmed. Of the rest every vertex takes
    the least vertex that reaches it as its color; a color's component is what
    reaches its root backwards inside the color. Components found are taken out
    and the rest goes into the next round, until one task can take what is left.
    An empty graph has none.
    """
    pairs = cut(pairs.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    found = None
    while True:
        pairs = _trim(pairs)
        left = pairs.count()
        if left <= local_edges:
            if left:
                part = pairs.coalesce(1).mapInPandas(_local_components, "key string, component string")
                found = part if found is None else found.unionByName(part)
            break
        vertices = pairs.select(F.col("src").alias("v")).distinct()
        colors = _spread(pairs, vertices.withColumn("color", F.col("v")))
        a, b = colors.selectExpr("v AS src", "color"), colors.selectExpr("v AS dst", "color AS color2")
        inside = cut(pairs.join(a, "src").join(b, "dst").where(F.col("color") == F.col("color2")).select("src", "dst", "color"))
        member = _confirm(inside)
        part = member.select(F.col("v").alias("key"), F.col("color").alias("component"))
        found = part if found is None else found.unionByName(part)
        gone = member.select("v")
        pairs = cut(
            pairs.join(gone.withColumnRenamed("v", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti")
            .select("src", "dst")
        )
    if found is None:
        return pairs.select(F.col("src").alias("key"), F.col("src").alias("component"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return found.join(sizes, "component", "left_semi").select("key", "component")


def degrees(es: DataFrame) -> DataFrame:
    """(key, in_degree, out_degree): numbers of edges, not of neighbours."""
    ends = es.select(F.col("dst").alias("key"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        es.select(F.col("src").alias("key"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return ends.groupBy("key").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


# --- queries -----------------------------------------------------------------


@query(f"""WITH RECURSIVE {EDGE}, starts AS (SELECT key FROM ent WHERE contains(key, '.auth.')),
      walk(key, depth) AS (SELECT key, 0 FROM starts UNION SELECT edge.dst, walk.depth + 1 FROM walk JOIN edge ON edge.src = walk.key WHERE walk.depth < 2)
    SELECT key, min(depth) AS depth FROM walk WHERE key NOT IN (SELECT key FROM starts) GROUP BY 1""")
def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """What the entities of the auth packages depend on, up to 2 steps away."""
    starts = current_entities(spark, d, "id").where(F.contains("key", F.lit(".auth."))).select("key")
    return reachable(edges(spark, d, "rel_type"), starts, 2)


_SHARED_SQL = "starts AS (SELECT key FROM ent WHERE key IN (SELECT lower(trim(id, ' ' || chr(9))) FROM shared_entities WHERE id IS NOT NULL))"


def shared_starts(spark: SparkSession, d: str) -> DataFrame:
    """(key): the current entities whose plain id is one of shared_entities."""
    shared = table(spark, d, "shared_entities").select(plain("id").alias("key"))
    return current_entities(spark, d, "id").select("key").join(shared, "key", "left_semi")


@query(f"""WITH RECURSIVE {EDGE}, {_SHARED_SQL},
      walk(key, depth) AS (SELECT key, 0 FROM starts UNION SELECT edge.src, walk.depth + 1 FROM walk JOIN edge ON edge.dst = walk.key WHERE walk.depth < 3)
    SELECT key, min(depth) AS depth FROM walk WHERE key NOT IN (SELECT key FROM starts) GROUP BY 1""")
def dependents(spark: SparkSession, d: str) -> DataFrame:
    """Entities that depend on any shared entity, up to 3 steps away."""
    return reachable(edges(spark, d, "rel_type").select(F.col("dst").alias("src"), F.col("src").alias("dst")), shared_starts(spark, d), 3)


@query(f"""WITH {EDGE}, {_SHARED_SQL}, c AS (SELECT DISTINCT src, dst, source_method FROM edge WHERE rel_type = 'call'),
      l1 AS (SELECT DISTINCT src, source_method FROM c WHERE dst IN (SELECT key FROM starts)),
      l2 AS (SELECT DISTINCT c.src, c.source_method FROM c JOIN (SELECT DISTINCT src FROM l1) f ON f.src = c.dst)
    SELECT src AS source, source_method, 1 AS depth FROM l1 UNION ALL SELECT src, source_method, 2 FROM l2""")
def find_callers(spark: SparkSession, d: str) -> DataFrame:
    """Callers of all shared entities, two levels."""
    calls = edges(spark, d, "source_method", "target_method").where(F.col("rel_type") == "call").select("src", "dst", "source_method", "target_method")
    return callers(calls, shared_starts(spark, d), 2)


CLOSURE = """one AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst),
      reach(src, dst) AS (SELECT src, dst FROM one UNION SELECT reach.src, one.dst FROM reach JOIN one ON one.src = reach.dst),
      scc AS (SELECT a.src AS key, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
      cyc AS (SELECT key, least(key, component) AS component FROM scc WHERE key IN (SELECT src FROM reach WHERE src = dst))"""


def scc(spark: SparkSession, d: str) -> DataFrame:
    return components(edges(spark, d, "rel_type"))


@query(f"WITH RECURSIVE {EDGE}, {CLOSURE} SELECT key, component FROM cyc")
def entities_in_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Entities on a cycle with the least member of their component."""
    return scc(spark, d)


@query(f"WITH RECURSIVE {EDGE}, {CLOSURE} SELECT component, count(*) AS size FROM cyc GROUP BY 1")
def cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles with their size."""
    return scc(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


_PKG = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') WHEN contains({0}, '.') THEN regexp_replace({0}, '\\.[^.]*$', '') ELSE {0} END"


@query(f"""WITH RECURSIVE {EDGE}, {CLOSURE} SELECT {_PKG.format('key')} AS package, count(DISTINCT component) AS cycles, count(*) AS members FROM cyc GROUP BY 1""")
def package_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles that touch a package, and its entities in them."""
    return (
        scc(spark, d)
        .groupBy(package_name(F.col("key")).alias("package"))
        .agg(F.countDistinct("component").alias("cycles"), F.count(F.lit(1)).alias("members"))
    )


_DEG = """deg AS (SELECT key, sum(i) AS in_degree, sum(o) AS out_degree FROM
      (SELECT dst AS key, 1 AS i, 0 AS o FROM edge UNION ALL SELECT src, 0, 1 FROM edge) GROUP BY 1)"""


@query(f"WITH {EDGE}, {_DEG} SELECT key, in_degree::BIGINT AS in_degree, out_degree::BIGINT AS out_degree FROM deg WHERE in_degree + out_degree >= 8")
def high_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Entities with at least 8 edges."""
    return degrees(edges(spark, d, "rel_type")).where(F.col("in_degree") + F.col("out_degree") >= 8)


@query(f"WITH {EDGE}, {_DEG} SELECT key FROM ent WHERE key NOT IN (SELECT key FROM deg)")
def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities without any edge."""
    return current_entities(spark, d, "id").select("key").join(degrees(edges(spark, d, "rel_type")).select("key"), "key", "left_anti")


@query(f"WITH {EDGE}, {_DEG} SELECT key, in_degree::BIGINT AS in_degree FROM deg ORDER BY in_degree DESC, key LIMIT 10")
def top_depended_on(spark: SparkSession, d: str) -> DataFrame:
    """The 10 entities with most edges in."""
    return degrees(edges(spark, d, "rel_type")).select("key", "in_degree").orderBy(F.desc("in_degree"), "key").limit(10)


@query(f"""WITH {ENT} SELECT key, coalesce(len(list_filter(members, lambda m: m.type IN ('method', 'constructor'))), 0)::INT AS methods FROM ent ORDER BY methods DESC, key LIMIT 10""")
def top_by_methods(spark: SparkSession, d: str) -> DataFrame:
    """The 10 entities with most methods."""
    from strataspark.operators.lookups import count_members

    e = current_entities(spark, d, "members").select("key", count_members("method", "constructor").alias("methods"))
    return e.orderBy(F.desc("methods"), "key").limit(10)


@query(f"WITH {EDGE}, {_DEG} SELECT key, out_degree::BIGINT AS out_degree FROM deg ORDER BY out_degree DESC, key LIMIT 10")
def top_dependers(spark: SparkSession, d: str) -> DataFrame:
    """The 10 entities with most edges out."""
    return degrees(edges(spark, d, "rel_type")).select("key", "out_degree").orderBy(F.desc("out_degree"), "key").limit(10)


@query(f"WITH {EDGE} SELECT rel_type, count(*) AS n FROM edge GROUP BY 1")
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Resolved edges by type."""
    return edges(spark, d, "rel_type").groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGE} SELECT rel.id, rel.source IN (SELECT endpoint FROM ends) AS source_known, rel.target IN (SELECT endpoint FROM ends) AS target_known FROM rel WHERE rel.id NOT IN (SELECT id FROM edge)")
def dangling_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations with an end that no current entity stands for, and which."""
    from strataspark.sources.graph import resolver

    ends = resolver(current_entities(spark, d, "name")).select("end")
    a = ends.select(F.col("end").alias("source"), F.lit(True).alias("a"))
    b = ends.select(F.col("end").alias("target"), F.lit(True).alias("b"))
    r = relations(spark, d, "rel_type").join(a, "source", "left").join(b, "target", "left")
    flags = r.select("id", F.coalesce("a", F.lit(False)).alias("source_known"), F.coalesce("b", F.lit(False)).alias("target_known"))
    return flags.where(~(F.col("source_known") & F.col("target_known")))


@query(f"""WITH {REL} SELECT round(coalesce(avg(CASE WHEN inference_source IS NOT NULL AND inference_source <> 'explicit' THEN 1.0 ELSE 0.0 END), 0), 2) AS ratio, count(*) AS relations FROM rel""")
def inferred_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of relations that were inferred."""
    inferred = F.col("inference_source").isNotNull() & (F.col("inference_source") != "explicit")
    r = relations(spark, d, "inference_source")
    return r.agg(F.round(F.coalesce(F.avg(F.when(inferred, 1.0).otherwise(0.0)), F.lit(0.0)), 2).alias("ratio"), F.count(F.lit(1)).alias("relations"))


def exact_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, ...): relations whose ends are ids of entities themselves; names are not resolved."""
    ids = current_entities(spark, d, "id").select("key")
    r = relations(spark, d, "rel_type").withColumnsRenamed({"source": "src", "target": "dst"})
    return r.join(ids.withColumnRenamed("key", "src"), "src", "left_semi").join(ids.withColumnRenamed("key", "dst"), "dst", "left_semi")


@query(f"""WITH RECURSIVE {ENT}, {REL}, edge AS (SELECT rel.*, rel.source AS src, rel.target AS dst FROM rel WHERE source IN (SELECT key FROM ent) AND target IN (SELECT key FROM ent)), {CLOSURE}
    SELECT component, count(*) AS size FROM cyc GROUP BY 1""")
def exact_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of relations between ids, without names."""
    return components(exact_edges(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


# --- cycles seen from their edges --------------------------------------------


def cycle_edges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, component): pairs whose ends lie in the same component; self loops are none."""
    a, b = members.select(F.col("key").alias("src"), "component"), members.select(F.col("key").alias("dst"), F.col("component").alias("c2"))
    inside = pairs.select("src", "dst").where(F.col("src") != F.col("dst")).distinct().join(a, "src").join(b, "dst")
    return inside.where(F.col("component") == F.col("c2")).drop("c2")


def severity(members: DataFrame) -> DataFrame:
    """(component, size, severity): a cycle of two is a warning, a longer one an error."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("severity", F.when(F.col("size") == 2, "warning").otherwise("error"))


def has_cycle(pairs: DataFrame) -> bool:
    """Whether there is a cycle of at least two vertices."""
    return not components(pairs).isEmpty()


@query(f"""WITH RECURSIVE {EDGE}, {CLOSURE} SELECT DISTINCT e.src, e.dst, a.component FROM edge e JOIN cyc a ON a.key = e.src JOIN cyc b ON b.key = e.dst AND b.component = a.component WHERE e.src <> e.dst""")
def edges_in_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Edges between entities of the same cycle."""
    e = edges(spark, d, "rel_type")
    return cycle_edges(e, components(e))


@query(f"WITH RECURSIVE {EDGE}, {CLOSURE} SELECT component, count(*) AS size, CASE WHEN count(*) = 2 THEN 'warning' ELSE 'error' END AS severity FROM cyc GROUP BY 1")
def cycle_severities(spark: SparkSession, d: str) -> DataFrame:
    """Cycles with their severity."""
    return severity(scc(spark, d))
