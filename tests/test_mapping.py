import pytest
from pyspark.sql import functions as F

from strataspark.operators import mapping as m


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def triples(df):
    rows = [(r.rel_type, r.source, r.target) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).collect()[0].x


JAVA = [("Owner", "Owner"), ("Map<String, X>", None), ("Repo<T>", "Repo"), ("Owner[]", "Owner"), ("int", None), ("java.util.List", None), ("T", None), ("K1", None), ("a.b.C", "a.b.C"), ("Response", None), ("", None)]


@pytest.mark.parametrize("kind,want", JAVA)
def test_java_types(spark, kind, want):
    assert one(spark, m.java_type(F.col("t")), t=kind) == want


def test_java_relations(spark):
    classes = frame(spark, [("p.A", "p"), ("B", ""), ("p.C", None)], "id string, package string")
    supers = frame(spark, [("p.A", "Base"), ("p.A", "q.Other"), ("B", "Base"), ("p.C", "Base"), ("none", "X"), ("p.A", None)], "id string, name string")
    faces = frame(spark, [("p.A", "I"), ("p.A", "I")], "id string, name string")
    uses = frame(spark, [("p.A", "Owner"), ("p.A", "Owner[]"), ("p.A", "String"), ("p.A", None)], "id string, type string")
    assert triples(m.java_relations(classes, supers, faces, uses)) == {
        ("inheritance", "p.A", "p.Base"), ("inheritance", "p.A", "q.Other"), ("inheritance", "B", "Base"), ("inheritance", "p.C", "Base"), ("implementation", "p.A", "p.I"), ("dependency", "p.A", "p.Owner"),
    }
    assert m.java_relations(classes.limit(0), supers, faces, uses).count() == 0


CPP = [
    ("Node", ["Node"], "composition"), ("std::unique_ptr<Node>", ["unique_ptr", "Node"], "composition"), ("Node*", ["Node"], "aggregation"), ("const engine::Mesh&", ["const", "engine::Mesh"], "aggregation"),
    ("std::vector<Node*>", ["vector", "Node"], "aggregation"), ("std::map<Key, Node>", ["map", "Node"], "composition"), ("std::unique_ptr<Node, Deleter>", ["unique_ptr", "Node"], "composition"), ("Box<T>", ["Box"], "composition"),
]


@pytest.mark.parametrize("kind,names,relation", CPP)
def test_cpp_types(spark, kind, names, relation):
    assert one(spark, m.cpp_types(F.col("t")), t=kind) == names
    assert one(spark, m.cpp_field(F.col("t")), t=kind) == relation


def test_cpp_relations(spark):
    names = frame(spark, [("Node", "e.Node"), ("Node", "z.Node"), ("engine::Mesh", "e.Mesh"), ("Self", "e.Self"), (None, "x")], "name string, id string")
    pairs = "id string, name string"
    bases = frame(spark, [("e.Self", "engine::Mesh"), ("e.Self", "Self"), ("e.Self", "Unknown")], pairs)
    fields = frame(spark, [("e.Self", "std::map<int, Node>"), ("e.Self", "Node*"), ("e.Self", "int")], "id string, type string")
    uses = frame(spark, [("e.Self", "std::vector<Node>"), ("e.Self", "Node&")], "id string, type string")
    assert triples(m.cpp_relations(bases, fields, uses, names)) == {("inheritance", "e.Self", "e.Mesh"), ("composition", "e.Self", "e.Node"), ("aggregation", "e.Self", "e.Node"), ("dependency", "e.Self", "e.Node")}


def test_kotlin_relations(spark):
    entities = frame(spark, [("a.Shape", "Shape", "interface", 1), ("b.Shape", "Shape", "class", 0), ("a.Base", "Base", "class", 2), ("a.Unnamed", None, "class", 3)], "id string, name string, entity_type string, ordinal int")
    schema = "id string, package string, name string"
    supers = frame(spark, [("a.X", "a", "Shape"), ("a.X", "a", "Unnamed"), ("a.X", "a", "a.Shape"), ("a.X", "a", "Nobody"), ("a.Base", "a", "Base"), ("a.X", "a", None)], schema)
    fields = frame(spark, [("a.X", "a", "Base"), ("a.X", "a", "Base")], schema)
    assert triples(m.kotlin_relations(supers, fields, entities)) == {("inheritance", "a.X", "b.Shape"), ("inheritance", "a.X", "a.Unnamed"), ("implementation", "a.X", "a.Shape"), ("composition", "a.X", "a.Base")}


def test_receiver_calls(spark):
    sites = frame(spark, [("p.A", "p", "run", "Store", "get"), ("p.A", "p", "run", "Store", "get"), ("p.A", "p", "run", "Other", "x"), ("p.A", "p", "run", None, "y")], "id string, package string, method string, receiver string, called string")
    known = frame(spark, [("Store",), ("Store",), (None,)], "name string")
    show = lambda df: [tuple(r) for r in df.collect()]
    assert show(m.receiver_calls(sites, known, "java")) == [("p.A", "p.Store", "run", "get", "direct", 0.6)]
    assert show(m.receiver_calls(sites, known, "python")) == [("p.A", "Store", "run", "get", "indirect", 0.4)]


def test_go_relations(spark):
    calls = frame(spark, [("p.q.F", "r.T.G", "indirect", 0.4), ("p.q.F", "r.T.G", "direct", 0.7), ("F", "r.G", "direct", 0.7), ("p.F", "G", "direct", 0.7)], "`from` string, `to` string, type string, confidence double")
    assert [tuple(r) for r in m.flow_calls(calls).collect()] == [("p.q", "r.T", "F", "G", "direct", 0.7)]
    imports = frame(spark, [("core", "mod/api"), ("core", "mod/core"), ("core", "mod/none"), ("core", "other/api"), ("core", "mod/api"), ("core", None)], "package string, path string")
    packages = frame(spark, [("core",), ("api",)], "package string")
    assert triples(m.go_dependencies(imports, packages, "mod")) == {("dependency", "core", "api")}


def test_language_server_comes_first(spark):
    schema = "raw_id int, struct string, interface string"
    found = frame(spark, [(1, "S", "I"), (1, "S", "I")], schema)
    matched = frame(spark, [(1, "S", "J", 0.8), (1, "T", "I", 0.8), (2, "S", "I", 0.9)], schema + ", confidence double")
    got = {tuple(r) for r in m.with_language_server(found, matched).collect()}
    assert got == {(1, "S", "I", 0.99, "server"), (1, "T", "I", 0.8, "names"), (2, "S", "I", 0.9, "names")}


def test_goroutines_and_channels(spark):
    schema = "package string, owner string, ops array<struct<operation:string,name:string,line:int>>, goes array<struct<line:int,function:string,args:array<string>>>"
    rows = [
        ("p", "Run", [("make", "jobs", 3), ("make", None, 4), ("send", "jobs", 5), ("make", "out", 6)], [(7, "work", ["ctx", "out", "jobs"]), (8, "", ["other"]), (9, "<anonymous>", ["jobs"]), (10, None, None)]),
        ("p", "S.Loop", None, [(2, "work", ["jobs"])]), ("p", "Idle", [], []),
    ]
    b = frame(spark, rows, schema)
    assert sorted(tuple(r) for r in m.spawns(b).collect()) == [
        ("p.Run", "p.Run.spawn-10", "go-func"), ("p.Run", "p.Run.spawn-7", "go-stmt"), ("p.Run", "p.Run.spawn-8", "go-func"), ("p.Run", "p.Run.spawn-9", "go-func"), ("p.S.Loop", "p.S.Loop.spawn-2", "go-stmt"),
    ]
    assert sorted((r.id, r.name) for r in m.channels(b).collect()) == [("chan-p-3", "jobs"), ("chan-p-4", None), ("chan-p-6", "out")]
    assert {tuple(r) for r in m.channel_edges(b).collect()} == {
        ("p.Run", "chan-p-3", "make"), ("p.Run", "chan-p-6", "make"), ("chan-p-6", "p.Run.spawn-7", "recv"), ("chan-p-3", "p.Run.spawn-9", "recv"),
    }


FILES = [
    ("src/parser/a.ts", None, False, "parser"), ("/w/x/src/cli/b/c.ts", None, False, "cli"), ("src/a.ts", None, False, ""), ("lib/a.ts", None, False, "lib"), ("a.ts", None, False, ""),
    ("/w/src/core/q/a.ts", "/w", False, "src/core/q"), ("/w/a.ts", "/w/", False, ""), ("mod/src/main/java/p/A.java", None, True, "mod"), ("/w/up/mod/src/test/java/A.java", "/w", True, "mod"),
    ("java11/src/main/java/A.java", None, True, "main"), ("mod\\src\\main\\java\\A.java", None, True, "mod"), ("mod/src/main/java/p/A.java", None, False, "main"),
]


@pytest.mark.parametrize("file,root,java,want", FILES)
def test_packages_of_files(spark, file, root, java, want):
    assert one(spark, m.file_package(F.col("f"), root, java), f=file) == want


def test_canonical_order(spark):
    member = "struct<name:string,type:string,visibility:string>"
    e = frame(spark, [("b", "x", [("z", "m", "p"), ("a", None, "p"), ("a", "f", None)]), ("a", None, None), (None, "q", [])], f"key string, name string, members array<{member}>")
    got = [(r.key, r.members and [x.name + str(x.type) for x in r.members]) for r in m.canonical(e).collect()]
    assert got == [("a", None), ("b", ["af", "aNone", "zm"]), (None, [])]


def test_merging_and_edges(spark):
    a, b = frame(spark, [(1, "x")], "id int, name string"), frame(spark, [(2, True)], "id int, flag boolean")
    assert sorted((r.id, r.name, r.flag) for r in m.merge_results(a, b).collect()) == [(1, "x", None), (2, None, True)]
    es = frame(spark, [("e2", "uses", "a", "b"), ("e1", "uses", "a", "b"), ("e3", "creates", "a", "b")], "id string, rel_type string, source string, target string")
    assert sorted(r.id for r in m.distinct_edges(es).collect()) == ["e1", "e3"]


def test_quality(spark):
    e = frame(spark, [("s", i) for i in range(25)] + [("t", 0), ("u", 0)], "k string, e int")
    r = frame(spark, [("s", "hub", f"x{i}") for i in range(12)] + [("u", f"a{i}", "b") for i in range(80)], "k string, source string, target string")
    c = {x.k: x.complexity for x in m.complexity(e, r, ["k"]).collect()}
    assert c == {"s": 100 - 10 - 4, "t": 100, "u": 0}
    q = m.quality(frame(spark, [(80.0, 50.0, 60.0, 55.0), (60.0, 60.0, 60.0, 60.0)], ", ".join(f"{p} double" for p in m.QUALITY)))
    assert [(x.score, x.valid) for x in q.collect()] == [(61, True), (60, True)]
    p = frame(spark, [("core/a", 3), ("core/b", 5), ("api", 9), ("core/0", 3)], "package string, fan_in int")
    assert [x.package for x in m.named(p, "core").collect()] == ["core/b", "core/0", "core/a"]
