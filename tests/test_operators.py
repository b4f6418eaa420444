"""The reference operators on small graphs and tables with known results."""

import datetime as dt
import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from strataspark.functions import text as tx
from strataspark.operators import coverage, health, history, layers, lookups, rollups
from strataspark.sources.graph import edges as resolved_edges


def value(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(expr).collect()[0][0]


@pytest.mark.parametrize(
    "path,depth,want", [("a.py", 1, "."), ("src/a.py", 1, "src"), ("src/x/a.py", 2, "src/x"), ("src/a.py", 5, "src/a.py")]
)
def test_package_path(spark, path, depth, want):
    assert value(spark, tx.package_path(F.col("p"), depth), p=path) == want


def test_names_and_paths(spark):
    assert value(spark, tx.package_name(F.col("p")), p="a/b/c.d") == "a/b" and value(spark, tx.package_name(F.col("p")), p="a.b.c") == "a.b"
    assert value(spark, tx.package_name(F.col("p")), p="abc") == "abc" and value(spark, tx.dotted_package(F.col("p"), 2), p="a..b.c") == "a.b"
    assert value(spark, tx.plain("p"), p=" \tAb\t ") == "ab" and value(spark, tx.slug(F.col("p")), p="Src/My File.ts") == "src-my-file-ts"
    assert value(spark, tx.dirname(F.col("p")), p="a") == "." and value(spark, tx.basename(F.col("p")), p="a/b.c") == "b.c"


def test_globs(spark):
    hits = lambda g, p: value(spark, F.col("p").rlike(tx.glob_to_regex(g)), p=p)
    assert hits("src/**/*.ts", "src/a/b/c.ts") and hits("src/**/*.ts", "src/c.ts") and not hits("src/*.ts", "src/a/c.ts")
    assert hits("*.{api,cli}.*", "x.cli.y") and not hits("a?c", "a/c") and hits("a.b", "a.b") and not hits("a.b", "axb")


def test_gini(spark):
    rows = [("e", v) for v in (3, 3, 3)] + [("f", 5)] + [("z", 0)] * 3 + [("h", v) for v in (0, 0, 0, 100)] + [("s", v) for v in (1, 2, 3, 4, 5)] + [("s", None)]
    got = {r.k: r.gini for r in rollups.gini(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()}
    assert got == {"e": pytest.approx(0), "f": pytest.approx(0), "z": 0, "h": pytest.approx(0.75), "s": pytest.approx(0.2667, abs=1e-4)}


def test_members_and_attributes(spark):
    schema = "key string, name string, entity_type string, is_abstract boolean, attributes map<string,string>, members array<struct<type:string>>"
    e = spark.createDataFrame(
        [("a", "A", "class", True, {"x": "1"}, [("method",), ("field",), ("method",)]), ("b", "B", "class", None, None, None), ("c", "A", "abstract_class", None, {"x": "2", "y": None}, [])], schema
    )
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(lookups.by_name(e, "A")) == ["a", "c"] and keys(lookups.by_type(e, "abstract_class")) == ["a", "c"] and keys(lookups.by_type(e, "class")) == ["a", "b"]
    assert keys(lookups.by_attributes(e, {"x": None})) == ["a", "c"] and keys(lookups.by_attributes(e, {"x": "1"})) == ["a"] and keys(lookups.by_attributes(e, {"y": None, "x": "2"})) == ["c"]
    assert [r[0] for r in e.orderBy("key").select(lookups.count_members("method")).collect()] == [2, 0, 0]
    with pytest.raises(ValueError):
        lookups.narrow(e, "galaxy")


def test_relations_for_scopes(spark):
    r = spark.createDataFrame([("a", "b", "call"), ("a", "b", "call"), ("a", "c", "call"), ("a", "c", "dependency"), ("b", "string", "dependency"), ("b", "[x]", "association")], "source string, target string, rel_type string")
    assert sorted(map(tuple, lookups.for_scope(r, "class").collect())) == [("a", "b", "dependency"), ("a", "c", "dependency"), ("b", "[x]", "association"), ("b", "string", "dependency")]
    assert lookups.for_scope(r, "package").count() == 3 and lookups.for_scope(r, "method").count() == 6
    kept = lookups.without_external(r, spark.createDataFrame([("[x]",)], "key string"))
    assert sorted(x.target for x in kept.collect()) == ["[x]", "b", "b", "c", "c"]


CHANGES = [("r", f"c{i}", p, a, dt.date(2024, 1, i + 1), 2, None) for i, p, a in [(0, "src/foo.ts", "al"), (1, "src/foo.ts", "al"), (2, "src/bar.ts", "al"), (1, "src/bar.ts", "bo"), (3, "x.ts", None)]]


def changes(spark):
    return spark.createDataFrame(CHANGES, "scope_key string, sha string, path string, author string, commit_date date, added bigint, deleted bigint")


def test_history(spark):
    c = changes(spark)
    m = {r.path: r for r in history.file_metrics(c).collect()}
    assert (m["src/foo.ts"].commit_count, m["src/foo.ts"].added_lines, m["src/foo.ts"].deleted_lines, m["src/bar.ts"].author_count) == (2, 4, 0, 2)
    top = {(r.path, r.email): r["rank"] for r in history.contributors(c, history.FILE).collect()}
    assert top[("src/bar.ts", "al")] == 1 and top[("src/bar.ts", "bo")] == 2 and top[("x.ts", "unknown")] == 1
    assert {r.path: r.bus_factor for r in history.bus_factor(history.contributors(c, history.FILE), history.FILE).collect()} == {"src/foo.ts": 1, "src/bar.ts": 1, "x.ts": 1}
    co = {(r.target, r.neighbor): (r.joint, r.strength, r.window_coverage) for r in history.cochange(c).collect()}
    assert co == {("src/foo.ts", "src/bar.ts"): (1, 1 / 3, 0.5), ("src/bar.ts", "src/foo.ts"): (1, 1 / 3, 0.5)}
    risk = {r.path: r for r in history.file_risk(c, "2024-01-20").collect()}
    assert risk["x.ts"].recency == 0.7 and risk["src/foo.ts"].owner_concentration == 0 and risk["src/bar.ts"].cochange_breadth == pytest.approx(0.1)
    assert {r.package: r.commit_count for r in history.package_metrics(c).collect()} == {"src": 3, ".": 1}
    empty = c.limit(0)
    assert history.file_risk(empty).count() == history.nearest(history.cochange(empty)).count() == 0


@pytest.mark.parametrize("days,want", [(0, 1.0), (7, 1.0), (8, 0.7), (30, 0.7), (90, 0.4), (91, 0.1)])
def test_recency(spark, days, want):
    assert spark.range(1).select(history.recency(F.lit(days))).collect()[0][0] == want


def test_log(spark):
    sha = "a" * 8
    log = f"COMMIT_START\n{sha}\nal@x\n2024-01-02\n\n3\t1\tsrc/a b.ts\n-\t-\timg.png\n1\t1\tsrc/{{a => b}}.ts\nCOMMIT_START\nabc\nx\n2024-01-01\n1\t1\tz\nCOMMIT_START\n{sha}9\nx\nyesterday\n1\t1\tz\nCOMMIT_START\n{sha}7\nbo\n2024-01-03\n"
    df = spark.createDataFrame([(log,), ("",), (None,)], "value string")
    got = sorted(map(tuple, history.parse_log(df).collect()))
    assert got == [(sha, "al@x", dt.date(2024, 1, 2), "img.png", 0, 0), (sha, "al@x", dt.date(2024, 1, 2), "src/a b.ts", 3, 1)]


def test_snapshots(spark):
    names = ", ".join(f"{m} double" for m in rollups.METRICS)
    t = dt.datetime(2025, 1, 1)
    base = dict.fromkeys(rollups.METRICS, 10.0)
    rows = [("s", "c1", t, *base.values()), ("s", "c2", t + dt.timedelta(1), *(base | {"total_entities": 11.0, "scc_count": 11.0, "package_count": 10.2, "total_relations": 20.0, "gini_in_degree": None}).values())]
    rows += [rows[1], ("s", "c3", None, *base.values()), (None, "c4", t, *base.values())]
    s = spark.createDataFrame(rows, f"scope_key string, commit_sha string, taken_at timestamp, {names}")
    d = {r.metric: (r.delta, r.percent_change) for r in rollups.diff(s).collect()}
    assert d["total_entities"] == (1.0, 10.0) and d["gini_in_degree"] == (None, None)
    hint = rollups.directions(s).collect()[0]
    assert (hint.direction, hint.confidence, hint.expanding) == ("expansion", "low", 3)
    rules = rollups.metric_rules(rollups.unpivot(rollups.newest(s, 1), "scope_key"), [("scc_count", ">", 10), ("gini_in_degree", "<", 1), ("total_entities", "==", 11)])
    assert {r.metric: r.passed for r in rules.collect()} == {"scc_count": True, "gini_in_degree": False, "total_entities": True}


def test_directions_and_trends(spark):
    names = ", ".join(f"{m} double" for m in rollups.METRICS)
    day = lambda k: dt.datetime(2025, 1, k)
    base = dict.fromkeys(rollups.METRICS, 100.0)
    down = base | {"total_entities": 90.0, "total_relations": 95.0, "package_count": 80.0}
    series = {
        "one": [base], "same": [base, base], "small": [base, base | {"total_entities": 104.9, "total_relations": 104.0, "package_count": 104.0}],
        "down": [base, base, down], "zero": [base | {"scc_count": 0.0, "package_count": 0.0}, base | {"scc_count": 1.0}],
    }
    s = spark.createDataFrame([(k, f"c{i}", day(i + 1), *x.values()) for k, xs in series.items() for i, x in enumerate(xs)], f"scope_key string, commit_sha string, taken_at timestamp, {names}")
    got = {r.scope_key: (r.direction, r.confidence, r.expanding, r.contracting) for r in rollups.directions(s).collect()}
    assert got == {
        "one": ("insufficient_data", None, 0, 0), "same": ("stable", "low", 0, 0), "small": ("stable", "low", 0, 0), "down": ("contraction", "medium", 0, 3),
        "zero": ("stable", "low", 1, 0),  # from no cycle to one counts, from no package does not
    }
    health_series = {"r": [0.5, 0.503], "f": [0.5, 0.497], "s": [0.5, 0.5019], "one": [0.5], "gap": [0.5, None], "old": [0.1, 0.5, 0.5]}
    h = spark.createDataFrame([(k, i, v) for k, vs in health_series.items() for i, v in enumerate(vs)], "k string, at int, d double")
    assert {r.k: r.trend for r in rollups.trend(h, ["k"], "at", "d", "d").collect()} == {"r": "rising", "f": "decreasing", "s": "stable", "one": "stable", "gap": "stable", "old": "stable"}


def test_tiers_and_layers(spark):
    e = spark.createDataFrame([("g", v) for v in (1, 1, 2, 3, 10, 20, 30)] + [("same", 4), ("same", 4)], "g string, strength int")
    got = {(r.g, r.strength): r.tier for r in rollups.tiers(e, ["g"]).collect()}
    assert got == {("g", 1): 1.0, ("g", 2): 1.0, ("g", 3): 1.0, ("g", 10): 3.0, ("g", 20): 5.0 if math.floor(7 * 0.85) <= 5 else 3.0, ("g", 30): 5.0, ("same", 4): 1.0}
    f = spark.createDataFrame([("src",), ("src/core/x",), ("src/corex",), ("lib",), (None,)], "file string")
    assert [r.layer for r in rollups.longest_prefix(f, {"src": "s", "src/core": "k"}, "file").collect()] == ["s", "k", "s", None, None]


def test_go_layers(spark):
    nodes = spark.createDataFrame([(1, "p", 25, 1), (1, "q", None, None)], "raw_id int, id string, structs bigint, file_count bigint").withColumn("functions", F.lit(0))
    e = spark.createDataFrame([(1, "q", "p")] * 5 + [(1, "p", "p")], "raw_id int, source string, target string")
    f = {r.id: r for r in layers.fans(nodes, e).withColumn("r", layers.too_big()).collect()}
    assert f["p"].r == ["fan_in", "structs"] and f["q"].r == [] and f["q"].fan_out == 5
    assert {r.id: r.fan_in for r in layers.fans(nodes, e, distinct=True).collect()} == {"p": 2, "q": 0}
    ent = lambda rows: spark.createDataFrame(rows, "raw_id int, path string, name string")
    meth = spark.createDataFrame([(1, "0", "Get"), (1, "0", "Set"), (1, "0", "Set"), (1, "1", "Get"), (1, "2", "Get"), (1, "2", "Put"), (2, "1", "Set")], "raw_id int, parent_path string, name string")
    got = layers.implicit_implementations(ent([(1, "0", "S")]), ent([(1, "1", "I"), (1, "2", "J"), (1, "3", "Empty")]), meth).collect()
    assert [(r.struct, r.interface) for r in got] == [("S", "I")]


STEMS = [
    ("a/foo.test.ts", "foo"), ("foo.spec.jsx", "foo"), ("foo.test", "foo"), ("test_bar.py", "bar"), ("bar_test.py", "bar"), ("x/baz_test.go", "baz"), ("test-q.cpp", "q"), ("q_test.cc", "q"),
    ("FooTests.kt", "Foo"), ("TestFoo.kt", "Foo"), ("Testing.kt", "Testing"), ("PlainTest.java", "PlainTest.java"),
]


@pytest.mark.parametrize("file,want", STEMS)
def test_stems(spark, file, want):
    assert value(spark, coverage.stem(F.col("p")), p=file) == want


@pytest.mark.parametrize("file,want", [("src/a/Foo.ts", "Foo"), ("foo.bar.ts", "foo.bar"), (".hidden", ".hidden"), ("x/Makefile", "Makefile")])
def test_source_stems(spark, file, want):
    assert value(spark, coverage.source_stem(F.col("p")), p=file) == want


def test_places_of_tests(spark):
    files = ["tests/unit/a/b/x.test.ts", "test/a/x.spec.tsx", "__tests__/a/x.test.js", "tests/x.test.ts", "src/a/x.test.ts", "pkg/a/x_test.go", "tests/a/test_x.py"]
    t = spark.createDataFrame([(f, "s", f) for f in files], "test_id string, scope_key string, file string")
    got = {r.file: (r.dir, r.go_dir) for r in coverage.test_places(t).collect()}
    assert [got[f] for f in files] == [("a/b", None), ("a", None), ("a", None), ("tests", None), ("src/a", None), (None, "pkg/a"), (None, None)]


def brute_cover(tests, entities, imports):
    """Pair by pair, as the rules say."""
    import re
    from pathlib import PurePosixPath as P

    out = {}
    for tid, ts, tf in tests:
        name = P(tf).name
        stem = {f.split("/")[-1]: w for f, w in [*STEMS, ("other.test.ts", "other")]}.get(name, name)
        d = str(P(tf).parent)
        canonical = re.sub(r"^(?:tests?|__tests?__|spec)/", "", re.sub(r"^tests?/(?:unit|integration|e2e|functional|system)/", "", d))
        for key, es, ef in entities:
            w = 0.425 if (tid, key) in imports else 0.0
            ed = str(P(ef).parent)
            if ts == es and stem == P(ef).stem:
                w += 0.30
            if ts == es and re.search(r"\.(test|spec)\.(ts|tsx|js|jsx)$", tf) and canonical not in ("", ".") and re.sub(r"^(?:src|lib|app|source)/", "", ed) == canonical:
                w += 0.125
            if ts == es and tf.endswith("_test.go") and d == ed:
                w += 0.175
            if w:
                ids, score = out.get(key, ((), 0.0))
                out[key] = ((*ids, tid), min(1.0, score + w))
    return {k: (tuple(sorted(ids)), round(v, 6)) for k, (ids, v) in out.items()}


def test_coverage(spark):
    tests = [("t1", "s", "tests/unit/a/foo.test.ts"), ("t2", "s", "tests/a/foo.spec.jsx"), ("t3", "s", "pkg/baz_test.go"), ("t4", "z", "test_bar.py"), ("t5", "s", "tests/unit/a/other.test.ts"), ("t6", "s", "q_test.cc")]
    entities = [("e1", "s", "src/a/foo.ts"), ("e2", "s", "src/a/types.ts"), ("e3", "s", "pkg/baz.go"), ("e4", "s", "pkg/other.go"), ("e5", "z", "lib/bar.py"), ("e6", "s", "bar.py"), ("e7", "s", "x/foo.go"), ("e8", "s", "none.c")]
    imports = {("t1", "e1"), ("t1", "e7"), ("t4", "e1"), ("t4", "e6"), ("t3", "e4")}
    want = brute_cover(tests, entities, imports)
    schema = "test_id string, scope_key string, file string"
    t, e = spark.createDataFrame([*tests, tests[0]], schema), spark.createDataFrame(entities, schema.replace("test_id", "key"))
    i = spark.createDataFrame([*imports, ("t1", "e1"), ("gone", "e1"), ("t1", "gone")], "test_id string, key string")
    assert {r.key: (r.tests, round(r.score, 6)) for r in coverage.covers(t, e, i).collect()} == {k: (len(ids), v) for k, (ids, v) in want.items()}
    assert "e8" not in want and want["e1"][0] == ("t1", "t2", "t4", "t5")
    known = i.where("test_id != 'gone'")
    assert {r.key: tuple(r.test_ids) for r in coverage.covering_tests(t, e, known).collect()} == {k: ids for k, (ids, _) in want.items()}
    assert coverage.covers(t.limit(0), e, i.limit(0)).count() == 0
    files = spark.createDataFrame([("a", "unit", 4, 0, 1, 0), ("b", "performance", 2, 0, 0, 1), ("c", "debug", 1, 0, 0, 0), ("d", "unit", 0, 0, 0, 3)], "test_id string, test_type string, cases int, assertions int, skips int, covered int")
    found = {(r.test_id, r.issue) for r in coverage.issues(files).collect()}
    assert found == {("a", "zero_assertion"), ("a", "orphan_test"), ("a", "skip_accumulation"), ("a", "assertion_poverty"), ("c", "zero_assertion")}
    assert value(spark, coverage.is_test(F.col("p")), p="src/a.spec.ts") and not value(spark, coverage.is_test(F.col("p")), p="src/contest.ts")


def test_health(spark):
    assert (health.target_dimension(1000), health.target_dimension(5000)) == (308, 379)
    e = spark.createDataFrame([("a", "b", "call"), ("a", "b", "inheritance"), ("b", "c", None)], "src string, dst string, rel_type string")
    a = health.adjacency(e)
    assert {(r.src, r.dst): r.w for r in a.collect()} == {("a", "b"): 3.0, ("b", "c"): 1.0}
    stats = {r.dst: (r["mean"], r.sd) for r in health.column_statistics(a, 3).collect()}
    assert stats["b"] == (pytest.approx(1.0), pytest.approx(math.sqrt(2)))
    after = health.adjacency(spark.createDataFrame([("a", "b", "call"), ("d", "a", "call")], "src string, dst string, rel_type string"))
    got = {r.src: (r.status, r.drift, r.level) for r in health.drift(a, after).collect()}
    assert got == {"a": ("shared", 2.0, "significant"), "b": ("removed", 1.0, "moderate"), "d": ("added", 1.0, "moderate")}
    levels = spark.createDataFrame([(0.499,), (0.5,), (1.5,), (3.0,)], "d double").select(health.drift_level(F.col("d"))).collect()
    assert [r[0] for r in levels] == ["stable", "moderate", "significant", "critical"]


def test_projection_keeps_lengths(spark):
    a = spark.range(40).select(F.lit("v").alias("src"), F.col("id").cast("string").alias("dst"), F.lit(1.0).alias("w"))
    x = health.project(a, 400).collect()[0].x
    assert len(x) == 400 and sum(v * v for v in x) == pytest.approx(40, rel=0.3)


def test_projection_equals_a_product_of_matrices(spark):
    rows = [("hot", f"c{i}", 1.0 + i % 3) for i in range(4000)] + [(f"r{i % 50}", f"c{i}", 2.0) for i in range(500)] + [("last", "c1", -1.0)]
    a = spark.createDataFrame(rows, "src string, dst string, w double").repartition(5)
    k = 30
    h = {r.dst: r.h for r in a.select("dst", F.xxhash64("dst").alias("h")).distinct().collect()}
    signs = health._signs(np.array(list(h.values()), np.int64), k, 1)
    assert 0.3 < (signs != 0).mean() < 0.37 and abs(signs.mean()) < 0.02
    of = dict(zip(h, signs))
    want = {}
    for src, dst, w in rows:
        want[src] = want.get(src, 0) + w * of[dst]
    got = {r.src: r.x for r in health.project(a, k).collect()}
    assert set(got) == set(want) and all(np.allclose(got[s], want[s] * math.sqrt(3 / k)) for s in want)
    assert health.project(a.limit(0), k).count() == 0


def test_dimension_and_clusters(spark):
    rows = [([float(i), 2.0 * i, 0.0],) for i in range(20)] + [(None,)]
    n, curve = health.intrinsic_dimension(spark.createDataFrame(rows, "v array<double>"), "v")
    assert n == 1 and curve[0] == pytest.approx(1.0)
    assert health.intrinsic_dimension(spark.createDataFrame([(None,)], "v array<double>"), "v") == (0, [])
    assert health.intrinsic_dimension(spark.createDataFrame([([1.0, 1.0],)] * 3, "v array<double>"), "v") == (0, [])
    pts = [("p", [0.0, 0.1 * i]) for i in range(6)] + [("q", [9.0, 0.1 * i]) for i in range(6)]
    scored = health.boundary(health.clusters(spark.createDataFrame(pts, "package string, v array<double>"), "v", 2)).collect()
    assert sorted((r.package, r.purity, r.coverage, r.score) for r in scored) == [("p", 1.0, 1.0, 1.0), ("q", 1.0, 1.0, 1.0)]
    cells = {"even": (2, 2), "most": (3, 2), "three": (2, 2, 1), "tiny": (1, 1), "four": (4, 2, 2, 2)}
    split = spark.createDataFrame([(p, c) for p, ns in cells.items() for c, n in enumerate(ns) for _ in range(n)], "package string, cluster int")
    got = {r.package: (r.purity, r.clusters) for r in health.split_packages(split).collect()}
    assert got == {"three": (0.4, [0, 1, 2]), "four": (0.4, [0, 1, 2, 3])}  # half in one cluster is no split, nor are two entities a package
    mixes = {0: (4, 6), 1: (4, 3, 3), 2: (5, 3, 2), 3: (9,), 4: (2, 2, 2, 2)}
    fused = spark.createDataFrame([(c, f"p{k}") for c, ns in mixes.items() for k, n in enumerate(ns) for _ in range(n)], "cluster int, package string")
    assert {r.cluster: (r.packages, r.dominant_ratio) for r in health.fusions(fused).collect()} == {4: (4, 0.25)}  # 0.6 outside is not more than 0.6
    rows = health.boundary(split).collect()
    assert health.global_score(health.boundary(split)).collect()[0].score == pytest.approx(sum(r["size"] * r.score for r in rows) / sum(r["size"] for r in rows), abs=1e-4)


def test_projected_rows_keep_their_lengths(spark, data):
    """No more squared lengths leave 1 +- 0.3 than the tail bound of as many directions as the entities ask for allows."""
    from strataspark.sources.tables import current_entities

    k = health.target_dimension(current_entities(spark, data).count())
    rows = health.projected_rows(spark, data).collect()
    assert len(rows) == health.adjacency(resolved_edges(spark, data)).select("src").distinct().count() > 0
    outside = sum(not 0.7 <= r.projected / r.length <= 1.3 for r in rows)
    assert outside <= 2 * math.exp(-k * (0.3**2 / 4 - 0.3**3 / 6)) * len(rows)
    assert all(abs(r.projected * k / 3 - round(r.projected * k / 3)) < 1e-6 for r in rows if r.length == 1)
