from pyspark.sql import functions as F

from strataspark.functions import mining as m

TS = """export type Kind = "a" | "b";
enum Mode { ON = "on", OFF, MAX = 3 }
if (x === "a" && "b" == y) {}
switch (k) { case "a": break; case Mode.OFF: break; }
"""


def test_discriminators_and_dispersion(spark):
    files = spark.createDataFrame([("src/p/one.ts", TS), ("src/q/two.ts", 'if (k !== "a") {}'), ("src/q/three.ts", 'case "a":'), ("x.ts", None), ("y.ts", "")], "file string, text string")
    types = {tuple(r) for r in m.discriminators(files).collect()}
    one = "src/p/one.ts"
    assert types == {(one, "Kind", "union", "a"), (one, "Kind", "union", "b"), (one, "Mode", "enum", "on"), (one, "Mode", "enum", "OFF"), (one, "Mode", "enum", "3")}
    used = {tuple(r) for r in m.comparisons(files).collect()}
    assert used == {(one, 3, "a"), (one, 3, "b"), (one, 4, "a"), (one, 4, "OFF"), ("src/q/two.ts", 1, "a"), ("src/q/three.ts", 1, "a")}
    smells = {(r.type_name, r.value): (r.files, r.modules, r.severity) for r in m.dispersion(m.discriminators(files), m.comparisons(files)).collect()}
    assert smells == {("Kind", "a"): (3, 2, "warning")}
    assert m.across_modules(m.dispersion(m.discriminators(files), m.comparisons(files))).count() == 1


def test_manifests(spark):
    files = spark.createDataFrame(
        [
            ("a/requirements.txt", "# tools\nnumpy>=1.2\npandas\n"), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
            ("pom.xml", "<dependency><groupId>g</groupId><artifactId>core</artifactId><version>2</version></dependency>"),
            ("b/build.gradle.kts", 'implementation("org.x:y:1.0")\ntestImplementation("org.x:z")'), ("package.json", '{"dependencies": {"left": "^1"}, "devDependencies": {"right": "2"}}'), ("other.txt", "numpy"), ("go.mod", None),
        ],
        "file string, text string",
    )
    got = {tuple(r)[1:] for r in m.dependencies(files).collect()}
    assert got == {("numpy", "1.2"), ("pandas", ""), ("github.com/a/b", "1.2.3"), ("core", "2"), ("org.x:y", "1.0"), ("org.x:z", ""), ("left", "^1"), ("right", "2")}


def test_imports(spark):
    modules = spark.createDataFrame([("pkg.core",), ("core",), ("util.text",)], "module string")
    imports = spark.createDataFrame([("m", "pkg.core.Thing"), ("m", "top.core.X"), ("m", "os.path"), ("m", "__future__.annotations"), ("n", "util.text")], "module string, imported string")
    got = {(r.imported, r.target) for r in m.resolve_imports(imports, modules).collect()}
    assert got == {("pkg.core.Thing", "pkg.core"), ("top.core.X", "core"), ("util.text", "util.text")}


def test_languages(spark):
    repos = {
        "mixed": ["package.json", "src/a.ts", "src/a.ts", "tool/setup.py", "x.py", None],
        "low": ["go.mod", "main.go", "tests/a.go", "docs/x/b.go"],
        "hidden": ["node_modules/a/index.js", ".git/x.ts", "cmake-build-debug/a.cpp", "vendor/b.go"],
        "markers": ["setup.py", "setup.cfg", "a/setup.py", "a/Pipfile", "settings.gradle.kts", "A.KT", ".h", "b.hxx"],
        "none": ["README.md"],
    }
    paths = spark.createDataFrame([(r, p) for r, ps in repos.items() for p in ps], "repo string, path string")
    got = {}
    for r in m.language_scores(paths, ["repo"]).orderBy("repo", "rank").collect():
        got.setdefault(r.repo, []).append((r.language, r.score, r["rank"]))
    assert got["mixed"] == [("typescript", 44, 1), ("python", 20, 2)]  # 40 + 4; 12 + 2 files of 4
    assert got["low"] == [("go", 40 + 3 + 3, 1)]
    assert got["hidden"] == got["none"] == [("typescript", 0, 1)]
    # of three python names one lies at the root; both files named setup.py are files of python too
    assert got["markers"] == [("python", 40 + 2 * 12 + 2 * 4, 1), ("kotlin", 40 + 2 * 4, 2), ("cpp", 4, 3)]


def test_relative_imports(spark):
    imports = [("a.b.c", ".d"), ("a.b.c", "..x"), ("a.b.c", "..x.y"), ("a.b.c", "...."), ("a.b.c", "."), ("a.b.c", "__future__.x"), ("a.b.c", "a.b.c"), ("a.b.c", "__futures__"), ("a.b.c", "..."), ("a.b.c", ".....z")]
    known = spark.createDataFrame([(x,) for x in ("a.b.d", "a.x", "a.b", "a.b.c", "__futures__", "z")], "module string")
    got = {(r.imported, r.target) for r in m.resolve_imports(spark.createDataFrame(imports, "module string, imported string"), known).collect()}
    assert got == {(".d", "a.b.d"), ("..x", "a.x"), (".", "a.b"), ("__futures__", "__futures__")}


def test_module_spans(spark):
    df = spark.createDataFrame([(["src/b/x.ts", "src/a/y.ts", "/a/z.ts", "root.ts", "src/main.ts", "lib/q.ts"],), ([],), (None,)], "files array<string>")
    assert [r[0] for r in df.select(m.module_span(F.col("files"))).collect()] == [["a", "b", "lib"], [], None]
