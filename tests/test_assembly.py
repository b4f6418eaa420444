from pyspark.sql import functions as F

from strataspark.operators import assembly as a


def test_declarations(spark):
    code = "export class A extends B {\nclass C {\ninterface I\nclass P(Q):\nfunc (s *Store) Get(ctx"
    files = spark.createDataFrame([("x", code), ("y", None), ("z", "")], "file string, text string")
    got = {(r.kind, r.name, r.other) for r in a.declarations(files).collect()}
    assert {("class", "A", "B"), ("class", "C", ""), ("interface", "I", ""), ("class", "P", "Q"), ("method", "Store", "Get")} <= got


def test_relations_in_texts(spark):
    texts = {
        "ts": "export class A<T> extends B<T> implements I, J<K> {}\nexport interface I extends P, Q {}\nclass Lone {}",
        "py": "class C(Base, abc.ABC, metaclass=Meta):\n    pass\nclass D:\n    pass\nclass E(Base):",
        "cpp": "class F : public G, private ns::H {};",
        "md": "classDiagram\n  X <|-- Y\n  X *-- Z : has\n  X o-- W\n  X ..> V\n  X --> U\n  N <|.. M\n  X --> U",
    }
    df = spark.createDataFrame([*texts.items(), ("none", None), ("empty", "")], "file string, text string")
    got = {}
    for r in a.text_relations(df).collect():
        got.setdefault(r.file, []).append((r.rel_type, r.source, r.target))
    assert {f: sorted(x) for f, x in got.items()} == {
        "ts": [("implementation", "A", "I"), ("implementation", "A", "J"), ("inheritance", "A", "B"), ("inheritance", "I", "P"), ("inheritance", "I", "Q")],
        "py": [("inheritance", "C", "Base"), ("inheritance", "C", "abc.ABC"), ("inheritance", "E", "Base")],
        "cpp": [("inheritance", "F", "G"), ("inheritance", "F", "ns::H")],
        "md": [("aggregation", "X", "W"), ("association", "X", "U"), ("composition", "X", "Z"), ("dependency", "X", "V"), ("implementation", "M", "N"), ("inheritance", "Y", "X")],
    }


def test_repairs_and_merges(spark):
    e = spark.createDataFrame([("p.Base", "p"), ("q.Base", "q"), ("q.r.X", "q")], "key string, package string")
    r = spark.createDataFrame([(1, "p.Base"), (2, "z.Base"), (3, "none.Y"), (4, "q.Base")], "id int, target string")
    assert {x.id: x.target for x in a.repair_targets(r, e).collect()} == {1: "p.Base", 2: "p.Base", 3: "none.Y", 4: "q.Base"}
    assert {x.module: x.package for x in a.module_packages(e).collect()} == {"p": "p", "q": "q", "q.r": "q"}
    schema = "name string, methods array<string>, fields array<string>"
    h = spark.createDataFrame([("A", ["m"], ["f"]), ("B", ["x"], [])], schema)
    b = spark.createDataFrame([("A", ["n", "m"], ["g"]), ("B", ["y"], ["h"]), ("C", None, None)], schema)
    got = {x.name: (x.methods, x.fields, x.in_header, x.in_body) for x in a.merge_pairs(h, b).collect()}
    assert got == {"A": (["m", "n"], ["f"], True, True), "B": (["x", "y"], ["h"], True, True), "C": ([], [], False, False)}


def test_grouping(spark):
    e = spark.createDataFrame([("1", "src/core/a.go"), ("2", "src/b.go"), ("3", "doc/x"), ("4", None)], "key string, file string")
    rules = [("^src/core/", "core", 5), ("^src/", "source", 3), (r"\.go$", "go", 3)]
    assert [r.grp for r in a.groups(e, rules).orderBy("key").collect()] == ["core", "source", "other", "other"]
    g = spark.createDataFrame([("a", str(i)) for i in range(5)] + [("b", "1"), ("c", "1"), ("c", "2")], "g string, m string")
    assert sorted((r.g, r.m) for r in a.limited(g, 2, 2, "g", "m").collect()) == [("a", "0"), ("a", "1"), ("c", "1"), ("c", "2")]


CALLS = "pkg string, function string, receiver_type string, args array<string>"


def test_entry_points(spark):
    rows = [
        ("a", "HandleFunc", None, ['"/x"', "serveX"]), ("a", "HandleFunc", "*mux.Router", ['"/y"', "func(w, r) {}"]), ("a", "HandleFunc", "*other.Thing", None),
        ("a", "Handle", "", ['"/z"']), ("b", "GET", None, ['"/g"', "list"]), ("b", "Get", None, ['"/h"', "one"]), ("b", "RegisterUserServer", None, ["s", "impl"]), ("c", "AddTool", None, ["srv", "tool", "handle"]),
        ("d", "MustAddCommand", None, ["x", "run"]), ("d", "get", None, None), ("d", None, None, None),
    ]
    c = spark.createDataFrame(rows, CALLS)
    show = lambda df: sorted((r.pkg, r.function, r.framework, r.protocol, r.http_method, r.path, r.handler) for r in df.collect())
    assert show(a.entry_points(c, ["gorilla/mux"])) == [
        ("a", "Handle", "gorilla/mux", "http", None, '"/z"', ""), ("a", "HandleFunc", "gorilla/mux", "http", None, '"/x"', "serveX"), ("a", "HandleFunc", "gorilla/mux", "http", None, '"/y"', ""),
    ]
    assert show(a.entry_points(c, ["chi", "grpc", "mcp-gosdk", "mcp-go"])) == [
        ("b", "Get", "chi", "http", "GET", '"/h"', "one"), ("b", "RegisterUserServer", "grpc", "grpc", None, "s", "impl"), ("c", "AddTool", "mcp-gosdk", "mcp", None, "srv", "handle"),
    ]
    assert show(a.entry_points(c, [], {"mine": [(None, "et", "x", "custom", None, 0)]})) == [("b", "Get", "mine", "custom", None, '"/h"', '"/h"'), ("d", "get", "mine", "custom", None, "", "")]
    found = a.entry_points(c, ["net/http"])
    assert show(a.with_generic(found, c, ["pkg"]))[-2:] == [("c", "AddTool", "generic-heuristic", "custom", None, "srv", "tool"), ("d", "MustAddCommand", "generic-heuristic", "custom", None, "x", "run")]
    assert a.entry_points(c, []).count() == 0 and a.entry_points(c.limit(0), ["gin"]).count() == 0


def test_chains_of_protocols(spark):
    e = spark.createDataFrame([("e1", "http"), ("e2", "grpc")], "id string, protocol string")
    c = spark.createDataFrame([("c1", "e1"), ("c2", "e2"), ("c3", "none")], "id string, entry_point string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert tuple(map(ids, a.of_protocols(e, c, ["grpc"]))) == (["e2"], ["c2"])
    assert tuple(map(ids, a.of_protocols(e, c, []))) == (["e1", "e2"], ["c1", "c2", "c3"])
    assert tuple(map(ids, a.of_protocols(e, c, ["cli"]))) == ([], [])


def test_call_class(spark):
    calls = spark.createDataFrame([("f", "s.store"), ("f", "svc"), ("f", "cfg"), ("f", None), ("f", "unknown"), ("g", "svc")], "fn string, receiver string")
    context = spark.createDataFrame([("f", "store", "*Store"), ("f", "svc", "api.Service"), ("f", "cfg", "Config"), ("g", "svc", "*Impl"), ("f", None, "Store")], "fn string, name string, type string")
    names = spark.createDataFrame([("Store",), ("Service",), (None,)], "name string")
    got = {(r.fn, r.receiver): r.call_type for r in a.call_class(calls, context, names, ["fn"]).collect()}
    assert got == {("f", "s.store"): "interface", ("f", "svc"): "interface", ("f", "cfg"): "direct", ("f", None): "direct", ("f", "unknown"): "direct", ("g", "svc"): "direct"}


def test_noise(spark):
    quiet = ["len", "int64", "recover", "fmt.Println", "json.Marshal", "slog.Info", "net.Dial", "w.Write", "ctx.Done", "err.Error", "r.Body.Close", "r.PathValue"]
    said = ["lens", "store.Get", "jsonx.Do", "r.Other", "router.Handle", "os", None]
    c = spark.createDataFrame([(x,) for x in quiet + said], "callee string")
    assert {r.callee for r in a.without_noise(c, "callee").collect()} == set(said)
    assert [r[0] for r in spark.createDataFrame([("interface",), ("direct",), (None,)], "k string").select(a.call_confidence(F.col("k"))).collect()] == [0.8, 0.7, 0.4]


def test_lists_and_forest(spark):
    parts = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "!a"), ("k", 4, "c"), ("k", 5, "!d"), ("k", 6, "d"), ("k", 7, None), ("n", 1, "!x")], "k string, ordinal int, value string")
    assert {r.k: r["values"] for r in a.merge_lists(parts, ["k"]).collect()} == {"k": ["b", "c", "d"]}
    paths = spark.createDataFrame([("a/b/c",), ("a/b/d",), ("x/y",), ("a",), ("",), (None,)], "path string")
    got = {(r.node, r.parent, r.real) for r in a.path_forest(paths).collect()}
    assert got == {("a", None, True), ("a/b", "a", False), ("a/b/c", "a/b", True), ("a/b/d", "a/b", True), ("x/y", None, True)}
