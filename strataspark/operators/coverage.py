"""Which tests cover which entities, test metrics and test issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import basename, dirname
from strataspark.plans.registry import register
from strataspark.sources.graph import EDGE, edges
from strataspark.sources.tables import current_entities

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

#: Weights of the layers of evidence that a test covers an entity: it imports it, has its name, lies in its directory (by the rule of TypeScript, of Go) (fixed values).
IMPORT, NAME, DIRECTORY, GO_DIRECTORY = 0.425, 0.30, 0.125, 0.175
SKIPPED, POOR = 0.2, 1.0
#: (names of test files, what is cut off to get the name of what they test), by language (fixed values).
STEMS = [
    (r"\.(?:test|spec)(?:\.(?:ts|tsx|js|jsx))?$", r"\.(?:test|spec)(?:\.(?:ts|tsx|js|jsx))?$"),
    (r"\.py$", r"\.py$|^test_|_test(?=\.py$)"),
    (r"_test\.go$", r"_test\.go$"),
    (r"\.(?:cpp|cc|cxx)$", r"\.(?:cpp|cc|cxx)$|^test[-_]|[-_]test(?=\.(?:cpp|cc|cxx)$)"),
    (r"\.kts?$", r"\.kts?$|Tests?(?=\.kts?$)|^Test(?=[A-Z])"),
]
#: Tests to which the rule of directories of TypeScript applies, and what is cut off their directories and those of sources (fixed values).
BY_DIRECTORY = r"\.(?:test|spec)\.(?:ts|tsx|js|jsx)$"
TEST_ROOTS = (r"^tests?/(?:unit|integration|e2e|functional|system)/", r"^(?:tests?|__tests?__|spec)/")
SOURCE_ROOT = r"^(?:src|lib|app|source)/"

# --- operators ---------------------------------------------------------------


def stem(file: Column) -> Column:
    """The name of what a test file tests, by the conventions of five languages; the file's whole name where none applies."""
    name = basename(file)
    out = name
    for when, cut in reversed(STEMS):
        out = F.when(name.rlike(when), F.regexp_replace(name, cut, "")).otherwise(out)
    return out


def source_stem(file: Column) -> Column:
    """A source file's name without its last extension."""
    return F.regexp_replace(basename(file), r"(?<=.)\.[^.]*$", "")


def is_test(file: Column) -> Column:
    """Whether a path is a test's by the conventions of its language."""
    return F.coalesce(
        file.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$|(^|/)test_[^/]*\.py$|_test\.(py|go|cpp|cc|cxx)$|(^|/)test[-_][^/]*\.(cpp|cc|cxx)$|Tests?\.(kt|kts|java)$|(^|/)__tests__/"),
        F.lit(False),
    )


def test_places(tests: DataFrame) -> DataFrame:
    """Tests (test_id, scope_key, file) with stem, and the directories of sources they stand for: `dir` by the rule of TypeScript, `go_dir` by that of Go; null where a rule does not apply."""
    d = dirname(F.col("file"))
    canonical = d
    for root in TEST_ROOTS:
        canonical = F.regexp_replace(canonical, root, "")
    canonical = F.when(F.col("file").rlike(BY_DIRECTORY) & ~canonical.isin("", "."), canonical)
    return tests.select("test_id", "scope_key", "file", stem(F.col("file")).alias("stem"), canonical.alias("dir"), F.when(F.endswith("file", F.lit("_test.go")), d).alias("go_dir"))


def source_places(entities: DataFrame) -> DataFrame:
    """Entities (key, scope_key, file) with stem, `go_dir`, their directory, and `dir`, the same without the root of sources."""
    d = dirname(F.col("file"))
    return entities.select("key", "scope_key", source_stem(F.col("file")).alias("stem"), F.regexp_replace(d, SOURCE_ROOT, "").alias("dir"), d.alias("go_dir"))


def covers(tests: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(key, tests, score): entities with the number of tests that cover them, and how surely; those without any are left out.

    `tests` has (test_id, scope_key, file), `entities` (key, scope_key, file),
    `imports` (test_id, key). Weights add up over tests and layers, to 1 at
    most. A test without a scope or file covers by import only.

    Tests are counted per name and per directory before they meet entities, so
    no test is paired with all entities of its directory. A test that several
    layers find is counted once by adding and taking away such counts.
    """
    t, e = test_places(tests.dropDuplicates(["test_id"])), source_places(entities.dropDuplicates(["key"]))
    count = lambda *keys: t.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x)).groupBy("scope_key", *keys).agg(F.count(F.lit(1)).alias("_".join(["n", *keys])))
    out = e
    # a Go test has no `dir` and no other test a `go_dir`, so both never hold for one test
    for keys in (("stem",), ("dir",), ("go_dir",), ("stem", "dir"), ("stem", "go_dir")):
        out = out.join(count(*keys), ["scope_key", *keys], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    # an imported entity: is the test one of those its name or directory finds already?
    pairs = imports.select("test_id", "key").distinct().join(t, "test_id").join(e.select("key", F.struct("scope_key", "stem", "dir", "go_dir").alias("e")), "key")
    again = F.coalesce((F.col("scope_key") == F.col("e.scope_key")) & ((F.col("stem") == F.col("e.stem")) | F.coalesce(F.col("dir") == F.col("e.dir"), F.lit(False)) | F.coalesce(F.col("go_dir") == F.col("e.go_dir"), F.lit(False))), F.lit(False))
    imported = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_import"), F.count_if(~again).alias("n_only"))
    out = out.join(imported, "key", "left")
    found = n("n_stem") + n("n_dir") + n("n_go_dir") - n("n_stem_dir") - n("n_stem_go_dir") + n("n_only")
    score = IMPORT * n("n_import") + NAME * n("n_stem") + DIRECTORY * n("n_dir") + GO_DIRECTORY * n("n_go_dir")
    return out.select("key", found.alias("tests"), F.least(F.lit(1.0), score).alias("score")).where(F.col("tests") > 0)


def covering_tests(tests: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(key, test_ids): the tests themselves, for few chosen entities; the layers of evidence are one equi join."""
    places = lambda df, key: df.select(key, "scope_key", F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("place")) for c in ("stem", "dir", "go_dir")])).alias("x")).select(key, "scope_key", "x.*")
    found = places(test_places(tests), "test_id").join(places(source_places(entities), "key"), ["scope_key", "layer", "place"]).select("test_id", "key")
    imported = imports.select("test_id", "key").join(entities.select("key"), "key", "left_semi").select("test_id", "key")
    return found.unionByName(imported).groupBy("key").agg(F.sort_array(F.collect_set("test_id")).alias("test_ids"))


def package_tests(tests: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(scope_key, package, tests): different tests that cover anything of a package, which is a directory. Names and directories of a package's entities are united before tests meet them."""
    places = lambda df, *keys: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("place")) for c in ("stem", "dir", "go_dir")])).alias("x")).select(*keys, "x.*")
    e = source_places(entities).withColumn("package", F.col("go_dir"))
    mine = places(e, "scope_key", "package").distinct()
    found = places(test_places(tests), "test_id", "scope_key").join(mine, ["scope_key", "layer", "place"]).select("scope_key", "package", "test_id")
    imported = imports.select("test_id", "key").join(e.select("key", "scope_key", "package"), "key").select("scope_key", "package", "test_id")
    return found.unionByName(imported).distinct().groupBy("scope_key", "package").agg(F.count(F.lit(1)).alias("tests"))


def issues(tests: DataFrame) -> DataFrame:
    """(test_id, issue, severity) of tests with (test_id, test_type, cases, assertions, skips, covered)."""
    case = F.col("cases") > 0
    found = F.array_compact(
        F.array(
            F.when(case & (F.col("assertions") == 0) & (F.col("test_type") != "performance"), F.struct(F.lit("zero_assertion").alias("issue"), F.lit("warning").alias("severity"))),
            F.when((F.col("test_type") != "debug") & (F.col("covered") == 0), F.struct(F.lit("orphan_test").alias("issue"), F.lit("info").alias("severity"))),
            F.when(case & (F.col("skips") > SKIPPED * F.col("cases")), F.struct(F.lit("skip_accumulation").alias("issue"), F.lit("info").alias("severity"))),
            F.when(case & (F.col("assertions") < POOR * F.col("cases")) & ~F.col("test_type").isin("debug", "performance"), F.struct(F.lit("assertion_poverty").alias("issue"), F.lit("info").alias("severity"))),
        )
    )
    return tests.select("test_id", F.explode(found).alias("x")).select("test_id", "x.*")


def test_metrics(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, density of assertions and share of skips of groups of tests; 0 where there are no cases."""
    cases = F.sum("cases")
    share = lambda c: F.when(cases > 0, F.round(F.sum(c) / cases, 6)).otherwise(0.0)
    return tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), share("assertions").alias("assertion_density"), share("skips").alias("skip_ratio"),
        F.count_if(F.col("test_type") == "debug").alias("debug_files"),
    )


def bucket(score: Column) -> Column:
    """How well something is covered: good from 0.7, partial from 0.3."""
    return F.when(score >= 0.7, "good").when(score >= 0.3, "partial").otherwise("poor")


# --- queries -----------------------------------------------------------------
# The data have no test files. Every entity named ...Checker stands for one: it tests the least of the entities it uses, which it imports all, and its
# file has the name and place that the conventions of that entity's language give it. Cases, assertions and skips are counted from its members.

_CHECK = "Checker\\d*$"
#: Where the test of a source file lies, by extension: what stands before the directory without its root, before and after the name.
_CONVENTIONS = {"ts": ("tests/unit/", "", ".test.ts"), "py": ("tests/", "test_", ".py"), "go": ("src/", "", "_test.go"), "cpp": ("tests/", "test-", ".cpp"), "kt": ("src/", "", "Test.kt"), "java": ("src/", "", "Test.java")}


def _test_path(file: Column) -> Column:
    ext, where = F.regexp_extract(file, r"\.(\w+)$", 1), F.regexp_replace(dirname(file), SOURCE_ROOT, "")
    out = F.lit(None).cast("string")
    for e, (root, before, after) in _CONVENTIONS.items():
        out = F.when(ext == e, F.concat(F.lit(root), where, F.lit("/" + before), source_stem(file), F.lit(after))).otherwise(out)
    return out


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = current_entities(spark, d, "name", "scope_key", "source_location", "members", "entity_type").where(F.col("name").isNotNull() & F.col("scope_key").isNotNull() & F.col("source_location.file").isNotNull())
    e = e.withColumn("file", F.col("source_location.file"))
    checks = e.where(F.col("name").rlike(_CHECK))
    rest = e.where(~F.col("name").rlike(_CHECK)).select("key", "scope_key", "file")
    used = edges(spark, d, "rel_type").select(F.col("src").alias("test_id"), F.col("dst").alias("key")).distinct()
    used = used.join(checks.select(F.col("key").alias("test_id")), "test_id", "left_semi").join(rest.select("key", F.col("file").alias("of")), "key")
    subject = used.groupBy("test_id").agg(F.min_by("of", "key").alias("of"))
    tests = checks.withColumnRenamed("key", "test_id").join(subject, "test_id", "left")
    tests = tests.select("test_id", "scope_key", F.coalesce(_test_path(F.coalesce("of", "file")), "file").alias("file"), "members", "entity_type")
    return tests, rest, used.select("test_id", "key")


_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
_BASE = "regexp_replace({0}, '^.*/', '')"
_SOURCE_STEM = f"regexp_replace({_BASE}, '(.)\\.[^.]*$', '\\1')"
_ROOTLESS = f"regexp_replace({_DIR}, '{SOURCE_ROOT}', '')"
_PATH_SQL = "CASE regexp_extract({0}, '\\.(\\w+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{r}' || {_ROOTLESS} || '/{x}' || {_SOURCE_STEM} || '{y}'" for e, (r, x, y) in _CONVENTIONS.items()) + " END"
# the SQL cuts off what the conventions above put on, one ending and beginning at a time
_STEM_SQL = f"""CASE WHEN regexp_matches({_BASE}, '\\.(test|spec)(\\.(ts|tsx|js|jsx))?$') THEN regexp_replace({_BASE}, '\\.(test|spec)(\\.(ts|tsx|js|jsx))?$', '')
    WHEN {{0}} LIKE '%.py' THEN regexp_replace(regexp_replace(regexp_replace({_BASE}, '\\.py$', ''), '^test_', ''), '_test$', '')
    WHEN {{0}} LIKE '%\\_test.go' ESCAPE '\\' THEN regexp_replace({_BASE}, '_test\\.go$', '')
    WHEN regexp_matches({{0}}, '\\.(cpp|cc|cxx)$') THEN regexp_replace(regexp_replace(regexp_replace({_BASE}, '\\.(cpp|cc|cxx)$', ''), '^test[-_]', ''), '[-_]test$', '')
    WHEN regexp_matches({{0}}, '\\.kts?$') THEN regexp_replace(regexp_replace(regexp_replace({_BASE}, '\\.kts?$', ''), 'Tests?$', ''), '^Test([A-Z])', '\\1') ELSE {_BASE} END"""


def tests_sql(ent: str = "ent", edge: str = "edge") -> str:
    """The tests (te), the other entities (re), the pairs of evidence (lay) and what they cover (cov), as SQL views over entities and edges."""
    return f"""en AS (SELECT key, scope_key, source_location.file AS file, name, members, entity_type FROM {ent} WHERE name IS NOT NULL AND scope_key IS NOT NULL AND source_location.file IS NOT NULL),
  re AS (SELECT key, scope_key, file, {_SOURCE_STEM.format('file')} AS stem, {_ROOTLESS.format('file')} AS dir, {_DIR.format('file')} AS go_dir FROM en WHERE NOT regexp_matches(name, 'Checker[0-9]*$')),
  im AS (SELECT DISTINCT src AS test_id, dst AS key FROM {edge} WHERE src IN (SELECT key FROM en WHERE regexp_matches(name, 'Checker[0-9]*$')) AND dst IN (SELECT key FROM re)),
  ta AS (SELECT en.key, en.scope_key, members, entity_type, coalesce({_PATH_SQL.format('coalesce(o.file, en.file)')}, en.file) AS file
    FROM en LEFT JOIN (SELECT test_id, arg_min(file, re.key) AS file FROM im JOIN re USING (key) GROUP BY 1) o ON o.test_id = en.key WHERE regexp_matches(name, 'Checker[0-9]*$')),
  tb AS (SELECT *, {_STEM_SQL.format('file')} AS stem, {_DIR.format('file')} AS d FROM ta),
  te AS (SELECT *, CASE WHEN regexp_matches(file, '{BY_DIRECTORY}') THEN nullif(nullif(regexp_replace(regexp_replace(d, '{TEST_ROOTS[0]}', ''), '{TEST_ROOTS[1]}', ''), ''), '.') END AS dir,
    CASE WHEN ends_with(file, '_test.go') THEN d END AS go_dir FROM tb),
  lay AS (SELECT test_id, key, {IMPORT}::DOUBLE AS w FROM im UNION ALL SELECT te.key, re.key, {NAME}::DOUBLE FROM te JOIN re USING (scope_key, stem)
    UNION ALL SELECT te.key, re.key, {DIRECTORY}::DOUBLE FROM te JOIN re USING (scope_key, dir) UNION ALL SELECT te.key, re.key, {GO_DIRECTORY}::DOUBLE FROM te JOIN re USING (scope_key, go_dir)),
  cov AS (SELECT key, count(DISTINCT test_id) AS tests, least(1.0::DOUBLE, sum(w)) AS score FROM lay GROUP BY 1),
  tf AS (SELECT key AS test_id, scope_key, CASE WHEN entity_type = 'function' THEN 'debug' WHEN entity_type = 'enum' THEN 'performance' ELSE 'unit' END AS test_type,
    coalesce(len(list_filter(members, lambda m: m.type IN ('method', 'constructor'))), 0) AS cases, coalesce(len(list_filter(members, lambda m: m.field_type IS NOT NULL)), 0) AS assertions,
    coalesce(len(list_filter(members, lambda m: m.is_static)), 0) AS skips, coalesce((SELECT count(*) FROM im WHERE im.test_id = te.key), 0) AS covered FROM te)"""


_TESTS = f"{EDGE}, {tests_sql()}"


def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    """(key, tests, score) of all covered entities."""
    return covers(*_parts(spark, d))


def _tests(spark: SparkSession, d: str) -> DataFrame:
    tests, _, used = _parts(spark, d)
    n = used.groupBy("test_id").agg(F.count(F.lit(1)).alias("covered"))
    size = lambda test: F.coalesce(F.when(F.col("members").isNotNull(), F.size(F.filter("members", test))), F.lit(0))
    kind = F.when(F.col("entity_type") == "function", "debug").when(F.col("entity_type") == "enum", "performance").otherwise("unit")
    return tests.join(n, "test_id", "left").select(
        "test_id", "scope_key", kind.alias("test_type"), size(lambda m: m["type"].isin("method", "constructor")).alias("cases"),
        size(lambda m: m["field_type"].isNotNull()).alias("assertions"), size(lambda m: m["is_static"]).alias("skips"), F.coalesce("covered", F.lit(0)).alias("covered"),
    )


@query(f"WITH {_TESTS} SELECT key AS test_id, file, stem, dir, go_dir FROM te")
def coverage_test_files(spark: SparkSession, d: str) -> DataFrame:
    """The test files, what they test by their names, and the directories they stand for."""
    return test_places(_parts(spark, d)[0]).select("test_id", "file", "stem", "dir", "go_dir")


@query(f"WITH {_TESTS} SELECT key, list_sort(list(DISTINCT test_id)) AS test_ids FROM lay JOIN re USING (key) WHERE regexp_matches(file, '^src/core/') GROUP BY 1")
def coverage_links(spark: SparkSession, d: str) -> DataFrame:
    """The tests of the entities of one directory."""
    tests, rest, used = _parts(spark, d)
    return covering_tests(tests, rest.where(F.startswith("file", F.lit("src/core/"))), used)


@query(f"WITH {_TESTS} SELECT key, tests, round(score, 6) AS score FROM cov")
def coverage_entities(spark: SparkSession, d: str) -> DataFrame:
    return entity_scores(spark, d).withColumn("score", F.round("score", 6))


@query(f"""WITH {_TESTS}, n AS (SELECT scope_key, go_dir AS package, count(DISTINCT test_id) AS tests FROM lay JOIN re USING (key) GROUP BY 1, 2)
    SELECT a.*, coalesce(tests, 0) AS tests FROM (SELECT scope_key, go_dir AS package, count(*) AS total, count(*) FILTER (WHERE score > 0) AS covered, round(count(*) FILTER (WHERE score > 0)::DOUBLE / count(*), 6) AS ratio
    FROM re LEFT JOIN cov USING (key) GROUP BY 1, 2) a LEFT JOIN n USING (scope_key, package)""")
def coverage_packages(spark: SparkSession, d: str) -> DataFrame:
    """Share of covered entities of every package, and how many tests cover it."""
    tests, rest, used = _parts(spark, d)
    e = rest.join(covers(tests, rest, used), "key", "left")
    hit = F.count_if(F.col("score") > 0)
    g = e.groupBy("scope_key", dirname(F.col("file")).alias("package")).agg(F.count(F.lit(1)).alias("total"), hit.alias("covered"), F.round(hit / F.count(F.lit(1)), 6).alias("ratio"))
    return g.join(package_tests(tests, rest, used), ["scope_key", "package"], "left").withColumn("tests", F.coalesce("tests", F.lit(0)))


@query(f"""WITH {_TESTS}, b AS (SELECT re.key, CASE WHEN round(score, 6) >= 0.7 THEN 'good' WHEN round(score, 6) >= 0.3 THEN 'partial' ELSE 'poor' END AS bucket FROM re LEFT JOIN cov USING (key))
    SELECT bucket, count(*) AS entities FROM b GROUP BY 1""")
def coverage_heat(spark: SparkSession, d: str) -> DataFrame:
    """Entities by how well they are covered."""
    tests, rest, used = _parts(spark, d)
    e = rest.join(covers(tests, rest, used), "key", "left")
    return e.groupBy(bucket(F.round("score", 6)).alias("bucket")).agg(F.count(F.lit(1)).alias("entities"))


@query(f"""WITH {_TESTS} SELECT test_id, 'zero_assertion' AS issue, 'warning' AS severity FROM tf WHERE cases > 0 AND assertions = 0 AND test_type <> 'performance'
    UNION ALL SELECT test_id, 'orphan_test', 'info' FROM tf WHERE test_type <> 'debug' AND covered = 0 UNION ALL SELECT test_id, 'skip_accumulation', 'info' FROM tf WHERE cases > 0 AND skips > 0.2::DOUBLE * cases
    UNION ALL SELECT test_id, 'assertion_poverty', 'info' FROM tf WHERE cases > 0 AND assertions < cases AND test_type NOT IN ('debug', 'performance')""")
def coverage_issues(spark: SparkSession, d: str) -> DataFrame:
    return issues(_tests(spark, d))


@query(f"""WITH {_TESTS} SELECT scope_key, count(*) AS files, CASE WHEN sum(cases) > 0 THEN round(sum(assertions)::DOUBLE / sum(cases), 6) ELSE 0 END AS assertion_density,
    CASE WHEN sum(cases) > 0 THEN round(sum(skips)::DOUBLE / sum(cases), 6) ELSE 0 END AS skip_ratio, count(*) FILTER (WHERE test_type = 'debug') AS debug_files FROM tf GROUP BY 1""")
def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    return test_metrics(_tests(spark, d), ["scope_key"])


# --- tests and what they import -------------------------------------------------


def by_import(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(test_id, key): entities that tests import. `imports` has (test_id, imported), `entities` (key, package, file).

    An import names an entity, a package, a file, a directory of files or a
    file without its extension; each of these is an equi join, so nothing is
    compared with everything.
    """
    i = imports.select("test_id", F.regexp_replace("imported", r"^\./|/$", "").alias("x")).where(F.col("imported").isNotNull()).distinct()
    e = entities.select("key", "package", "file", F.regexp_replace("file", r"\.\w+$", "").alias("bare"), dirname(F.col("file")).alias("dir"))
    above = e.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))).alias("x"))
    branches = [e.select("key", F.col(c).alias("x")) for c in ("key", "package", "file", "bare")] + [above.where(F.col("x") != ".")]
    out = None
    for b in branches:
        part = i.join(b.where(F.col("x") != ""), "x").select("test_id", "key")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def details(links: DataFrame, tests: DataFrame) -> DataFrame:
    """(key, found, tests): the tests of every linked entity that exist, and whether any does. `links` has (key, test_ids ARRAY), `tests` (test_id)."""
    each = links.select("key", F.explode_outer("test_ids").alias("test_id"))
    known = each.join(tests.select("test_id", F.lit(1).alias("there")).distinct(), "test_id", "left")
    g = known.groupBy("key").agg(F.sort_array(F.collect_set(F.when(F.col("there").isNotNull(), F.col("test_id")))).alias("tests"))
    return g.select("key", (F.size("tests") > 0).alias("found"), "tests")
