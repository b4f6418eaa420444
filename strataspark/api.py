"""One call per question: the query surface over the tables below a folder.

Every method returns a DataFrame, unless it says otherwise. Depths lie in 1..5;
a name or target that nobody has gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import mining
from strataspark.functions.text import plain
from strataspark.operators import assembly, coverage, graph, health, history, layers, lookups, rollups
from strataspark.sources.graph import edges, relations
from strataspark.sources.scopes import resolve
from strataspark.sources.tables import commit_files, current_entities, table

#: Assertion patterns that suit a test framework (fixed values).
ASSERTIONS = {
    "vitest": ["expect("], "jest": ["expect("], "mocha": ["expect(", "assert."], "pytest": ["assert "], "unittest": ["self.assert"],
    "junit": ["assert", "Assertions."], "kotest": ["shouldBe", "shouldThrow"], "gtest": ["EXPECT_", "ASSERT_"], "testing": ["t.Error", "t.Fatal", "assert.", "require."],
}


class Engine:
    """Questions about the tables below `root`, of one scope or of all."""

    def __init__(self, spark: SparkSession, root: str, scope: str | None = None):
        self.spark, self.root, self.scope = spark, root, scope

    def _scoped(self, df: DataFrame) -> DataFrame:
        return df if self.scope is None else df.where(F.col("scope_key") == self.scope)

    @property
    def entities(self) -> DataFrame:
        """Entities of the scope, and the shared ones all scopes refer to."""
        e = current_entities(self.spark, self.root)
        return e if self.scope is None else e.where(F.col("scope_key").isin(self.scope, "commonlib"))

    @property
    def edges(self) -> DataFrame:
        return self._scoped(edges(self.spark, self.root))

    @property
    def commits(self) -> DataFrame:
        return self._scoped(commit_files(self.spark, self.root))

    def _named(self, name: str) -> DataFrame:
        return lookups.by_name(self.entities, name).select("key")

    # entities
    def entity(self, name: str, output: str = "method") -> DataFrame:
        return lookups.narrow(lookups.by_name(self.entities, name), output)

    def by_type(self, kind: str, attributes: dict[str, str | None] | None = None) -> DataFrame:
        return lookups.by_attributes(self.entities, attributes or {}, kind)

    def by_attributes(self, attributes: dict[str, str | None]) -> DataFrame:
        return lookups.by_attributes(self.entities, attributes)

    def in_file(self, path: str) -> DataFrame:
        return self.entities.where(F.col("source_location.file") == path)

    def relations(self, output: str = "method") -> DataFrame:
        return lookups.for_scope(self._scoped(relations(self.spark, self.root)), output)

    # graph
    def dependencies(self, name: str, depth: int = 1) -> DataFrame:
        return graph.reachable(self.edges, self._named(name), depth)

    def dependents(self, name: str, depth: int = 1) -> DataFrame:
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return graph.reachable(back, self._named(name), depth)

    def _below(self, name: str, kind: str) -> DataFrame:
        e = self.edges.where(F.col("rel_type") == kind).join(self._named(name).withColumnRenamed("key", "dst"), "dst", "left_semi")
        return e.select(F.col("src").alias("key")).distinct()

    def implementers(self, name: str) -> DataFrame:
        return self._below(name, "implementation")

    def subclasses(self, name: str) -> DataFrame:
        return self._below(name, "inheritance")

    def callers(self, target: str, depth: int = 1) -> DataFrame:
        """Callers of a class, or of `Class.method`; the method limits the first level."""
        name, _, method = target.partition(".")
        return graph.callers(self.edges.where(F.col("rel_type") == "call"), self._named(name), depth, method or None)

    def cycles(self) -> DataFrame:
        return graph.components(self.edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_set("key")).alias("members"))

    def in_cycles(self) -> DataFrame:
        return graph.components(self.edges)

    def high_coupling(self, threshold: int = 8) -> DataFrame:
        return graph.degrees(self.edges).where(F.col("in_degree") + F.col("out_degree") >= threshold)

    def orphans(self) -> DataFrame:
        return self.entities.select("key").join(graph.degrees(self.edges).select("key"), "key", "left_anti")

    def summary(self) -> DataFrame:
        """Totals and counts of relations by type, as (what, n)."""
        kinds = self.edges.groupBy(F.concat(F.lit("relations:"), F.coalesce("rel_type", F.lit("unknown"))).alias("what")).agg(F.count(F.lit(1)).alias("n"))
        total = self.entities.agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("what"), "n")
        return total.unionByName(kinds)

    # packages
    def package_stats(self, depth: int = 2, least_files: int = 0, least_loc: int = 0, top: int | None = None) -> DataFrame:
        p = rollups.package_stats(rollups.file_stats(self.entities, self.edges), depth)
        p = p.where((F.col("files") >= least_files) & (F.col("loc") >= least_loc)).orderBy(F.desc("loc"), "scope_key", "package")
        return p if top is None else p.limit(top)

    def _fans(self) -> DataFrame:
        return layers.fans(layers.layer(self.spark, self.root, "package_node"), layers.layer(self.spark, self.root, "package_edge"))

    def package_fan_in(self, least: int = 1, top: int = 20) -> DataFrame:
        return self._fans().where(F.col("fan_in") >= least).orderBy(F.desc("fan_in"), "raw_id", "id").limit(max(1, min(200, top)))

    def package_fan_out(self, least: int = 1, top: int = 20) -> DataFrame:
        return self._fans().where(F.col("fan_out") >= least).orderBy(F.desc("fan_out"), "raw_id", "id").limit(max(1, min(200, top)))

    def god_packages(self, limits: dict[str, int] | None = None) -> DataFrame:
        return self._fans().withColumn("reasons", layers.too_big(limits or layers.GOD_LIMITS)).where(F.size("reasons") > 0)

    def layer(self, kind: str) -> DataFrame:
        return layers.layer(self.spark, self.root, kind)

    # history
    def _risk(self, as_of: str) -> DataFrame:
        return history.file_risk(self.commits, as_of)

    def change_risk(self, path: str, as_of: str = history.AS_OF) -> DataFrame:
        return self._risk(as_of).where(F.col("path") == path)

    def change_context(self, path: str, as_of: str = history.AS_OF) -> DataFrame:
        m = history.file_metrics(self.commits).where(F.col("path") == path).withColumnRenamed("author_count", "authors")
        return m.join(self._risk(as_of).select("scope_key", "path", "risk_score", "risk_level", "top_factor"), history.FILE)

    def cochange(self, path: str, top: int = history.NEIGHBORS) -> DataFrame:
        return history.nearest(history.cochange(self.commits), top).where(F.col("target") == path)

    def ownership(self, path: str) -> DataFrame:
        c = history.contributors(self.commits.where(F.col("path") == path), history.FILE)
        return c.where(F.col("rank") <= history.CONTRIBUTORS).join(history.bus_factor(c, history.FILE), history.FILE)

    def evidence_pack(self, paths: list[str], as_of: str = history.AS_OF) -> DataFrame:
        """Risk of the paths asked for; `found` is false for those without history."""
        want = self.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
        r = self._risk(as_of).where(F.col("path").isin(paths)).select(*history.FILE, "risk_score", "risk_level", "top_factor")
        return F.broadcast(want).join(r, "path", "left").withColumn("found", F.col("risk_score").isNotNull())

    # tests
    def test_issues(self, severity: str | None = None) -> DataFrame:
        found = coverage.issues(self._scoped(coverage._tests(self.spark, self.root)))
        return found if severity is None else found.where(F.col("severity") == severity)

    def test_metrics(self) -> DataFrame:
        return coverage.test_metrics(self._scoped(coverage._tests(self.spark, self.root)), ["scope_key"])

    def entity_coverage(self, key: str | None = None) -> DataFrame:
        c = coverage.covers(*coverage._parts(self.spark, self.root))
        return c if key is None else c.where(F.col("key") == plain(F.lit(key)))

    @staticmethod
    def test_patterns(frameworks: list[str]) -> dict[str, list[str]]:
        """Assertion patterns for frameworks, as a dict; unknown ones have none."""
        return {f: ASSERTIONS.get(f.lower(), []) for f in frameworks}

    # numbers over time
    def diff(self) -> DataFrame:
        return rollups.diff(self._scoped(table(self.spark, self.root, "snapshots")))

    def direction(self) -> DataFrame:
        return rollups.directions(self._scoped(table(self.spark, self.root, "snapshots")))

    def check(self, rules: list[tuple[str, str, float]], forbidden: list[tuple[str, str]] | None = None) -> DataFrame:
        """(scope_key, rule, passed): metric rules on the newest snapshots, and pairs of globs that no relation may join."""
        s = rollups.unpivot(rollups.newest(self._scoped(table(self.spark, self.root, "snapshots")), 1), "scope_key")
        name = F.concat_ws(" ", "metric", "op", F.col("threshold").cast("string"))
        out = rollups.metric_rules(s, rules).select("scope_key", name.alias("rule"), "passed") if rules else None
        for a, b in forbidden or []:
            broken = rollups.forbidden(self._scoped(relations(self.spark, self.root)), a, b).agg(F.count(F.lit(1)).alias("n"))
            part = broken.select(F.lit(self.scope).cast("string").alias("scope_key"), F.lit(f"no {a} -> {b}").alias("rule"), (F.col("n") == 0).alias("passed"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no rules")
        return out

    def metric_trend(self, metric: str, keep: int = 500) -> DataFrame:
        s = rollups.newest(self._scoped(table(self.spark, self.root, "snapshots")), keep)
        return s.where(F.col(metric).isNotNull()).select("scope_key", "taken_at", metric)

    # structure
    def intrinsic_dimension(self, name: str = "embeddings", column: str = "embedding") -> tuple[int, list[float]]:
        """The dimension and the curve of explained variance, as numbers."""
        return health.intrinsic_dimension(table(self.spark, self.root, name), column)

    def drift(self, before: Engine, least: str = "stable", top: int | None = None) -> DataFrame:
        """Drift from another engine's edges to these, of at least a level, the largest first."""
        order = ["stable", "moderate", "significant", "critical"]
        d = health.drift(health.adjacency(before.edges), health.adjacency(self.edges))
        d = d.where(F.col("level").isin(order[order.index(least) :])).orderBy(F.desc("drift"), "src")
        return d if top is None else d.limit(top)

    def cluster_boundary(self, k: int = 10) -> DataFrame:
        e = table(self.spark, self.root, "embeddings").select("embedding", F.col("label").alias("package"))
        return health.boundary(health.clusters(e, "embedding", k))

    # texts
    def literal_dispersion(self, type_name: str | None = None, least: int = 2) -> DataFrame:
        t = table(self.spark, self.root, "documents").where(F.col("text").isNotNull()).select(F.concat_ws("#", "path", "doc_id").alias("file"), "text")
        d = mining.dispersion(mining.discriminators(t), mining.comparisons(t), least)
        return d if type_name is None else d.where(F.col("type_name") == type_name)

    def cognitive_summary(self, names: list[str], as_of: str = history.AS_OF) -> DataFrame:
        risks = self._risk(as_of).select("scope_key", "path", "risk_score")
        return assembly.cognitive_summary(names, self.entities, self.edges, self.entity_coverage(), risks)

    def scopes(self) -> DataFrame:
        return current_entities(self.spark, self.root).where(F.col("scope_key").isNotNull()).groupBy(F.col("scope_key").alias("key")).agg(F.count(F.lit(1)).alias("entities"))

    def with_scope(self, wanted: str | None) -> Engine:
        """The same for a scope by its key or a part of it; two matches, an exact key first, decide as all would."""
        known = [{"key": r.key, "label": r.key} for r in self.scopes().where(F.contains("key", F.lit(wanted or ""))).orderBy(F.col("key") != F.lit(wanted or ""), "key").limit(2).collect()]
        return Engine(self.spark, self.root, resolve(known, wanted))
