"""Operators on fixtures whose tables the test data do not have."""

import pytest
from pyspark.sql import functions as F

from strataspark.functions import mining
from strataspark.operators import coverage, graph, health, layers, rollups


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cycle_edges(spark):
    e = frame(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("c", "d"), ("d", "e"), ("e", "c")], "src string, dst string")
    m = graph.components(e)
    assert {(r.src, r.dst) for r in graph.cycle_edges(e, m).collect()} == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c")}
    assert {(r.component, r.size, r.severity) for r in graph.severity(m).collect()} == {("a", 2, "warning"), ("c", 3, "error")}
    assert graph.has_cycle(e) and not graph.has_cycle(e.where("src = 'b' and dst = 'c'"))


def test_promoted_methods(spark):
    own = frame(spark, [("A", "x"), ("B", "x"), ("B", "y"), ("C", "y"), ("C", "z"), ("L", "q"), (None, "n"), ("A", None)], "type string, method string")
    embeds = frame(spark, [("A", "B"), ("A", "C"), ("T", "A"), ("L", "M"), ("M", "L"), ("S", "S"), ("N", None)], "type string, embedded string")
    got = {(r.type, r.method, r.level) for r in layers.promoted_methods(own, embeds).collect() if r.type}
    assert {("A", "x", 0), ("A", "z", 1), ("T", "x", 1), ("T", "z", 2), ("L", "q", 0)} <= got
    assert not {x for x in got if x[:2] in {("A", "y"), ("T", "y"), ("M", "q")}}  # ambiguous, or from a cycle


def test_method_sets_of_values_and_pointers(spark):
    own = frame(spark, [("B", "val", False), ("B", "ptr", True), ("C", "x", None), ("D", "x", False), ("V", "val", True), ("Loop", "m", False)], "type string, method string, pointer boolean")
    embeds = frame(
        spark,
        [("V", "B", False), ("P", "B", True), ("PP", "P", False), ("Both", "C", False), ("Both", "D", False), ("Over", "Both", False), ("Over", "C", True), ("Loop", "Loop2", False), ("Loop2", "Loop", False), ("Sees", "Loop", False), ("Sees", "B", False),
         ("Left", "B", False), ("Right", "B", False), ("Diamond", "Left", False), ("Diamond", "Right", False)],
        "type string, embedded string, pointer boolean",
    )
    got = {}
    sets = layers.promoted_methods(own, embeds)
    for r in sets.collect():
        got.setdefault(r.type, set()).add((r.method, r.level, r.by_value))
    assert got["V"] == {("val", 0, False), ("ptr", 1, False)}  # its own method hides the embedded one
    assert got["P"] == {("val", 1, False), ("ptr", 1, False)} and got["PP"] == {("val", 2, False), ("ptr", 2, False)}
    assert got["Left"] == {("val", 1, True), ("ptr", 1, False)}
    assert "Both" not in got and got["Over"] == {("x", 1, False)}  # ambiguous below, so one way is left
    assert "Sees" not in got and got["Loop"] == {("m", 0, True)} and "Diamond" not in got
    faces = frame(spark, [("I", "val"), ("I", "ptr"), ("J", "x"), ("K", None), ("L", "val"), ("L", "none")], "interface string, method string")
    found = {tuple(r) for r in layers.embedded_implementations(sets, faces).collect()}
    assert found == {(t, "I") for t in ("B", "V", "P", "PP", "Left", "Right")} | {(t, "J") for t in ("C", "D", "Over")}


def test_field_uses(spark):
    fields = frame(spark, [("S", "app", "*store.Repo"), ("S", "app", "[]Local"), ("S", "app", "map[string]*alias.Thing"), ("S", "app", "int"), ("S", "app", None)], "owner string, package string, type_text string")
    imports = frame(spark, [("app", None, "x/store"), ("app", "alias", "y/deep")], "package string, alias string, path string")
    nodes = frame(spark, [("1", "x/store", "Repo", "struct"), ("2", "app", "Local", "struct"), ("3", "y/deep", "Thing", "interface"), ("S", "app", "S", "struct")], "id string, package string, name string, node_type string")
    uses = layers.field_uses(fields, imports, nodes)
    assert {tuple(r) for r in uses.collect()} == {("S", "1"), ("S", "2"), ("S", "3")}
    assert [tuple(r) for r in layers.concrete_risks(uses, nodes).collect()] == [("S", "1", "app", "x/store")]


def test_lifecycles_and_hotspots(spark):
    spawns = frame(spark, [("1", "run"), ("2", "loop"), ("3", "unknown"), ("4", "stopper")], "id string, target string")
    f = frame(spark, [("run", ["ctx context.Context"], None), ("loop", [], "for {}"), ("stopper", None, "<-s.quit")], "name string, params array<string>, body string")
    assert {r.id: (r.has_context, r.has_cancel, r.orphan) for r in layers.lifecycles(spawns, f).collect()} == {"1": (True, False, False), "2": (False, False, True), "3": (False, False, False), "4": (False, True, False)}
    n = frame(spark, [("a", 11, 0), ("b", 10, 5), ("c", None, 6)], "id string, methods int, fan_in int")
    assert sorted(r.id for r in layers.hotspots(n).collect()) == ["a", "c"]


def brute_silhouette(points):
    import numpy as np

    xs, cs = np.array([x for x, _ in points]), np.array([c for _, c in points])
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2))
    out = []
    for i, c in enumerate(cs):
        same = (cs == c) & (np.arange(len(cs)) != i)
        others = [d[i][cs == o].mean() for o in set(cs) - {c}]
        a = d[i][same].mean() if same.any() else None
        out.append(0.0 if a is None or not others else (min(others) - a) / max(a, min(others)))
    return sum(out) / len(out)


def test_silhouette_is_euclidean_and_exact(spark):
    import random

    rng = random.Random(2)
    points = [([rng.random() + 3 * (k % 3), rng.random() * (k % 3)], k % 3) for k in range(60)] + [([9.0, 9.0], 7)]
    df = frame(spark, points + [(None, 1)], "x array<double>, cluster int").repartition(3)
    assert health.silhouette(df, "x") == pytest.approx(brute_silhouette(points))
    assert health.silhouette(df, "x", sample=30) == pytest.approx(brute_silhouette(points), abs=0.15)
    assert health.silhouette(df.where("cluster = 7"), "x") == 0.0 and health.silhouette(df.limit(0), "x") == 0.0


def test_boundary_report(spark):
    rows = [(f"p{i}", f"t{i % 2}", 1.0) for i in range(8)] + [(f"q{i}", f"u{i % 2}", 1.0) for i in range(8)]
    a = frame(spark, rows, "src string, dst string, w double")
    packages = frame(spark, [(f"{p}{i}", p) for p in "pq" for i in range(8)] + [("lone", "p")], "key string, package string")
    report = health.boundary_report(a, packages)
    assert report["mode"] == "direct" and [r.key for r in report["orphans"].collect()] == ["lone"] and report["silhouette"] == 1.0 and report["clusters"] == 4
    assert {r.package for r in report["splits"].collect()} == set() and report["fusions"].count() == 0 and report["warning"] is None
    assert {(r.package, r["size"], r.purity) for r in report["scores"].collect()} == {("p", 8, 0.5), ("q", 8, 0.5)}
    assert health.features(a, 1000)[0] == "jl" and len(health.features(a, 1000)[1].first().x) == health.target_dimension(1000)
    with pytest.raises(ValueError):
        health.boundary_report(a.limit(1), packages)


def test_clusters(spark):
    pts = [([0.0 + 0.1 * (i % 3), 0.1 * (i // 3)], "p" if i < 6 else "q") for i in range(9)] + [([9.0 + 0.1 * i, 9.0], "q") for i in range(8)] + [(None, "q")]
    df = frame(spark, pts, "v array<double>, package string")
    k, s, c = health.choose_clusters(df, "v", 2)
    assert k == 2 and s > 0.9 and c.count() == 17
    summary = {r.dominant: (r["size"], r.packages) for r in health.cluster_summaries(c).collect()}
    assert summary == {"p": (9, 2), "q": (8, 1)}
    with pytest.raises(ValueError):
        health.choose_clusters(frame(spark, [([1.0],)] * 4, "v array<double>"), "v", 2)


def test_matrix_and_alignment(spark):
    a = frame(spark, [("a", "x", 2.0), ("b", "x", 2.0), ("a", "y", 3.0)], "src string, dst string, w double")
    z = {(r.src, r.dst): (round(r.z, 4), round(r.zero_z, 4)) for r in health.normalized(a, 2).collect()}
    assert z == {("a", "x"): (0.0, 0.0), ("b", "x"): (0.0, 0.0), ("a", "y"): (1.0, -1.0)}
    k = lambda *ks: frame(spark, [(x,) for x in ks], "key string")
    assert {tuple(r) for r in health.align(k("a", "b", "b"), k("b", "c")).collect()} == {("a", "removed"), ("b", "shared"), ("c", "added")}
    assert [health.drift_exit_code(*x) for x in ((False, True, []), (True, False, ["critical"]), (True, True, ["moderate", "critical"]), (True, True, ["moderate"]))] == [2, 0, 1, 0]


def test_packages(spark):
    p = frame(spark, [("a/b/c",), ("a/b/d",), ("x/y",), ("a",), ("",), (None,)], "package string")
    assert {tuple(r) for r in rollups.package_tree(p).collect()} == {("a", None, False), ("a/b", "a", True), ("a/b/c", "a/b", False), ("a/b/d", "a/b", False), ("x/y", None, False)}
    e = frame(spark, [("s", "a", "b"), ("s", "a", "b"), ("s", "a", "a")], "scope_key string, src string, dst string")
    v = frame(spark, [("a", "s"), ("b", "s"), ("c", "s"), ("z", "t")], "key string, scope_key string")
    assert {r.scope_key: (r.vertices, r.edges, r.isolated, r.density) for r in rollups.connectivity(e, v).collect()} == {"s": (3, 1, 1, 0.166667), "t": (1, 0, 1, 0.0)}
    h = frame(spark, [("t1", [("p", 1, 2, 0, 3), ("q", 0, 0, 0, 0)]), ("t2", []), ("t3", None)], "timestamp string, packages array<struct<name:string,fanIn:long,fanOut:long,cycleCount:long,entityCount:long>>")
    assert [tuple(r) for r in rollups.package_trend(h, "p").collect()] == [("t1", 1, 2, 0, 3)]


def test_imports_of_tests(spark):
    e = frame(spark, [("k1", "pkg", "src/a/one.ts"), ("k2", "pkg", "src/b/two.ts"), ("k3", "other", "lib/x.py")], "key string, package string, file string")
    i = frame(spark, [("t1", "./src/a/one"), ("t2", "pkg"), ("t3", "src"), ("t4", "k3"), ("t5", "lib/x.py"), ("t6", "nothing"), ("t7", None)], "test_id string, imported string")
    got = {}
    for r in coverage.by_import(i, e).collect():
        got.setdefault(r.test_id, set()).add(r.key)
    assert got == {"t1": {"k1"}, "t2": {"k1", "k2"}, "t3": {"k1", "k2"}, "t4": {"k3"}, "t5": {"k3"}}
    links = frame(spark, [("a", ["t1", "gone", "t1"]), ("b", ["gone"]), ("c", None)], "key string, test_ids array<string>")
    d = {r.key: (r.found, r.tests) for r in coverage.details(links, i.select("test_id")).collect()}
    assert d == {"a": (True, ["t1"]), "b": (False, []), "c": (False, [])}


def test_projects(spark):
    m = frame(spark, [("web", "web-app"), ("core", "core-lib")], "module string, artifact string")
    d = frame(spark, [("web", "core-lib"), ("web", "web-app"), ("core", "junit")], "module string, dependency string")
    assert [tuple(r) for r in mining.cross_module(m, d).collect()] == [("web", "core")]
    i = frame(spark, [("github.com/gin-gonic/gin",), ("net/http/httptest",), ("net/url",)], "path string")
    assert sorted(r.framework for r in mining.frameworks(i).collect()) == ["gin", "net/http"]
    g = frame(spark, [("a", "b", "x"), ("a", "b", "y"), ("a", "b", "y"), ("a", "a", "z")], "source string, target string, name string")
    assert [tuple(r) for r in mining.module_graph(g).collect()] == [("a", "b", 3, ["x", "y"])]
    t = frame(spark, [("Map<string, number>", "data-store/core_parts")], "t string, n string")
    assert tuple(t.select(mining.without_generics(F.col("t")), mining.label(F.col("n")), mining.label(F.col("n"), 6)).collect()[0]) == ("Map", "Data Store Core Parts", "Data …")


def test_methods_are_promoted_from_any_depth(spark):
    from strataspark.operators.layers import promoted_methods

    own = spark.createDataFrame([("t8", "run")], "type string, method string")
    embeds = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(8)], "type string, embedded string")
    assert {tuple(r) for r in promoted_methods(own, embeds).collect()} == {(f"t{i}", "run", 8 - i, True) for i in range(9)}
