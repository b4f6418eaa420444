"""Mining of source text: discriminators and their dispersion, manifests, languages, imports. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.functions.text import package_path
from strataspark.plans.registry import register
from strataspark.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

# Patterns of declarations and comparisons of string literals (fixed values).
UNION = r'type\s+(\w+)\s*=\s*((?:"[^"]*"\s*\|\s*)*"[^"]*")'
ENUM = r"enum\s+(\w+)\s*\{([^}]*)\}"
EQUAL = r'(?:===?\s*"[^"]+")|(?:"[^"]+"\s*===?)'
CASE = r'case\s+"([^"]+)":'
CASE_MEMBER = r"case\s+\w+\.(\w+)\s*:"

# --- operators ---------------------------------------------------------------


def discriminators(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, type_name, kind, value): values of string-literal unions and of enums; an enum member without a value is its own.

    Null texts declare nothing; a value is given once per type and file.
    """
    rows = files.select(F.col(file).alias("file"), F.col(text).alias("text"))

    def pairs(pattern: str) -> Column:
        names, bodies = (F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in (1, 2))
        return F.explode(F.arrays_zip(names.alias("n"), bodies.alias("b"))).alias("x")

    unions = rows.select("file", pairs(UNION)).select(
        "file", F.col("x.n").alias("type_name"), F.lit("union").alias("kind"), F.explode(F.regexp_extract_all("x.b", F.lit('"([^"]*)"'), F.lit(1))).alias("value")
    )
    members = rows.select("file", pairs(ENUM)).select("file", F.col("x.n").alias("type_name"), F.explode(F.split("x.b", ",")).alias("m"))
    name = F.regexp_extract("m", r"^\s*(\w+)", 1)
    given = F.regexp_extract("m", r"""=\s*["']?([^"']*?)["']?\s*$""", 1)
    enums = members.where(name != "").select("file", "type_name", F.lit("enum").alias("kind"), F.when(given != "", given).otherwise(name).alias("value"))
    return unions.unionByName(enums).distinct()


def comparisons(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line, value): comparisons with a literal, by line from 1: equality either way round, case of a literal or of an enum member."""
    lines = files.select(F.col(file).alias("file"), F.posexplode(F.split(text, r"\r?\n")).alias("at", "line_text"))
    equal = F.transform(F.regexp_extract_all("line_text", F.lit(EQUAL), F.lit(0)), lambda m: F.regexp_extract(m, '"([^"]+)"', 1))
    found = F.concat(equal, F.regexp_extract_all("line_text", F.lit(CASE), F.lit(1)), F.regexp_extract_all("line_text", F.lit(CASE_MEMBER), F.lit(1)))
    return lines.select("file", (F.col("at") + 1).alias("line"), F.explode(found).alias("value"))


def dispersion(types: DataFrame, used: DataFrame, least: int = 2, warn: int = 3) -> DataFrame:
    """(type_name, value, files, modules, severity): values of a type that at least `least` files compare with or define."""
    places = types.select("type_name", "value", "file").unionByName(
        types.select("type_name", "value").distinct().join(used.select("value", "file").distinct(), "value").select("type_name", "value", "file")
    )
    out = places.distinct().groupBy("type_name", "value").agg(
        F.count(F.lit(1)).alias("files"), F.size(F.array_distinct(F.collect_set(package_path(F.col("file"), 2)))).alias("modules")
    )
    return out.where(F.col("files") >= least).withColumn("severity", F.when(F.col("files") >= warn, "warning").otherwise("info"))


def module_span(files: Column, root: str = "src") -> Column:
    """The different modules of an array of files: the first folder below a root, which need not be there; files without a folder belong to none."""
    below = F.transform(files, lambda f: F.regexp_replace(F.when(F.startswith(f, F.lit(root)), F.substring(f, len(root) + 1, F.length(f))).otherwise(f), "^/", ""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(below, lambda f: F.contains(f, F.lit("/"))), lambda f: F.substring_index(f, "/", 1))))


def across_modules(smells: DataFrame) -> DataFrame:
    """Smells that reach more than one module."""
    return smells.where(F.col("modules") >= 2)


#: File name -> pattern of a dependency in it: (group of the name, group of the version) (fixed values).
MANIFESTS = {
    "requirements.txt": (r"(?m)^\s*([A-Za-z0-9_.\-]+)\s*(?:\[[^\]]*\])?\s*(?:[=<>!~]=?\s*([\w.*]+))?", 1, 2),
    "go.mod": (r"(?m)^\s*(?:require\s+)?([\w.\-]+(?:/[\w.\-]+)+)\s+v([\w.\-+]+)", 1, 2),
    "pom.xml": (r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)\s*</artifactId>(?:\s*<version>\s*([^<\s]*)\s*</version>)?", 1, 2),
    "build.gradle": (r"""(?:implementation|api|compile|testImplementation|runtimeOnly)\s*\(?\s*["']([^"':]+:[^"':]+)(?::([^"']+))?["']""", 1, 2),
    "build.gradle.kts": (r"""(?:implementation|api|compile|testImplementation|runtimeOnly)\s*\(?\s*["']([^"':]+:[^"':]+)(?::([^"']+))?["']""", 1, 2),
}


def dependencies(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, dependency, version): what manifests declare; package.json by its three sections, others by pattern. No version is an empty text."""
    name = F.regexp_replace(F.col(file), "^.*/", "")
    out = None
    for manifest, (pattern, a, b) in MANIFESTS.items():
        rows = files.where(name == manifest).select(F.col(file).alias("file"), F.regexp_replace(F.col(text), r"(?m)^\s*#.*$", "").alias("t"))
        both = F.arrays_zip(F.regexp_extract_all("t", F.lit(pattern), F.lit(a)).alias("d"), F.regexp_extract_all("t", F.lit(pattern), F.lit(b)).alias("v"))
        part = rows.select("file", F.explode(both).alias("x")).select("file", F.col("x.d").alias("dependency"), F.coalesce("x.v", F.lit("")).alias("version"))
        part = part.where(F.col("dependency") != "")
        out = part if out is None else out.unionByName(part)
    sections = F.from_json(F.col(text), "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    npm = files.where(name == "package.json").select(F.col(file).alias("file"), sections.alias("s"))
    for section in ("dependencies", "devDependencies", "peerDependencies"):
        part = npm.select("file", F.explode(F.col(f"s.{section}")).alias("dependency", "version"))
        out = out.unionByName(part)
    return out.distinct()


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, imported, target): the first known module of an import.

    Candidates are the dotted path without its first 0, 1, ... parts, each
    shortened from the right, in this order. Leading dots stand for the package
    of the importing module, every further one for the package above; such an
    import is the whole path or nothing, and too many dots lead nowhere.
    Imports of __future__, of the module itself and those that meet no known
    module are left out. `imports` has (module, imported).
    """
    dots = F.length(F.regexp_extract("imported", r"^(\.*)", 1))
    above = F.split("module", r"\.")
    base = F.slice(above, 1, F.greatest(F.size(above) - dots, F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace("imported", r"^\.+", ""), r"\."), lambda x: x != "")
    parts = F.when(dots == 0, F.split("imported", r"\.")).when(dots <= F.size(above), F.concat(base, rest))
    i = imports.where(~F.col("imported").rlike(r"^__future__(?:\.|$)")).select("module", "imported", parts.alias("p"), (dots > 0).alias("whole")).where(F.size("p") > 0)
    ones = F.array(F.lit(1))
    left = i.select("*", F.explode(F.when(F.col("whole"), ones).otherwise(F.sequence(F.lit(1), F.size("p")))).alias("l"))
    both = left.select("*", F.explode(F.when(F.col("whole"), ones).otherwise(F.sequence(F.lit(1), F.size("p") - F.col("l") + 1))).alias("r"))
    length = F.size("p") - F.col("l") + 2 - F.col("r")
    tried = both.select("module", "imported", F.array_join(F.slice("p", F.col("l"), length), ".").alias("target"), F.struct("l", "r").alias("order"))
    hit = tried.join(modules.select(F.col("module").alias("target")).distinct(), "target")
    best = hit.groupBy("module", "imported").agg(F.min_by("target", "order").alias("target"))
    return best.where(F.col("target") != F.col("module"))


#: Extensions of files and names of marker files of languages (fixed values).
LANGUAGES = {
    "cpp": (("cpp", "cxx", "cc", "hpp", "hxx", "h"), ("CMakeLists.txt", "Makefile")),
    "go": (("go",), ("go.mod",)),
    "java": (("java",), ("pom.xml", "build.gradle")),
    "kotlin": (("kt", "kts"), ("build.gradle.kts", "settings.gradle.kts")),
    "python": (("py",), ("pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile")),
    "typescript": (("ts", "tsx"), ("package.json", "tsconfig.json")),
}
#: Folders that are not looked into, beside those that begin with a dot or cmake-build- (fixed values).
SKIPPED = ("node_modules", "build", "dist", "coverage", "vendor", "third_party", "thirdparty", "target", "__pycache__", "venv", "experiments")
#: Folders whose files count less (fixed values).
LOW_PRIORITY = ("scripts", "tests", "test", "examples", "docs", "doc", "bench")
ROOT_MARKER, NESTED_MARKER, PRIORITY = 40, 12, 3


def language_scores(paths: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """(keys, language, score, markers, root_markers, priority_files, total_files, rank): the languages of projects by the paths of their files.

    A file counts 1 and 3 more outside of low-priority folders, a marker at the
    root 40, every other marker's name 12. Files below skipped folders do not
    count. A project without any language gets typescript with a score of 0.
    A path given twice counts once; null paths make no project.
    """
    parts = F.split(F.col(path), "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    out_of_sight = F.exists(folders, lambda x: F.startswith(x, F.lit(".")) | F.startswith(x, F.lit("cmake-build-")) | x.isin(*SKIPPED))
    low = F.exists(folders, lambda x: x.isin(*LOW_PRIORITY))
    rows = paths.where(F.col(path).isNotNull()).select(*keys, path).distinct().select(
        *keys, F.when(~out_of_sight, name).alias("n"), F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1)).alias("e"), low.alias("low"), (F.size(folders) == 0).alias("root")
    )
    each = []
    for language, (exts, markers) in LANGUAGES.items():
        file, marker = F.col("n").isNotNull() & F.col("e").isin(*exts), F.col("n").isin(*markers)
        each.append(
            F.struct(
                F.lit(language).alias("language"), F.sort_array(F.collect_set(F.when(marker, F.col("n")))).alias("markers"),
                F.coalesce(F.max((marker & F.col("root")).cast("bigint")), F.lit(0)).alias("root_markers"), F.count_if(file & ~F.col("low")).alias("priority_files"), F.count_if(file).alias("total_files"),
            )
        )
    x = rows.groupBy(*keys).agg(F.array(*each).alias("s")).select(*keys, F.explode("s").alias("x")).select(*keys, "x.*")
    score = F.col("root_markers") * ROOT_MARKER + (F.size("markers") - F.col("root_markers")) * NESTED_MARKER + F.col("priority_files") * PRIORITY + F.col("total_files")
    w = Window.partitionBy(*keys)
    x = x.withColumn("score", score.cast("bigint")).withColumn("any", F.max("score").over(w))
    kept = x.where((F.col("score") > 0) | (F.col("any") == 0) & (F.col("language") == "typescript"))
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "language"))).drop("any")


# --- queries -----------------------------------------------------------------

_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_LANG_SQL = " UNION ALL ".join(
    f"SELECT scope_key, '{lang}' AS language, list_sort(coalesce(list(DISTINCT n) FILTER (WHERE n IN ({_quoted(marks)})), [])) AS markers, count(DISTINCT n) FILTER (WHERE n IN ({_quoted(marks)})) AS k,"
    f" coalesce(max(CASE WHEN root AND n IN ({_quoted(marks)}) THEN 1 ELSE 0 END), 0)::BIGINT AS root_markers, count(*) FILTER (WHERE n IS NOT NULL AND NOT low AND e IN ({_quoted(exts)})) AS priority_files,"
    f" count(*) FILTER (WHERE n IS NOT NULL AND e IN ({_quoted(exts)})) AS total_files FROM q GROUP BY 1"
    for lang, (exts, marks) in LANGUAGES.items()
)


@query(f"""WITH p AS (SELECT DISTINCT scope_key, path, string_split(path, '/')[:-2] AS d, string_split(path, '/')[-1] AS name FROM commit_files WHERE path <> '' AND scope_key IS NOT NULL),
      q AS (SELECT scope_key, CASE WHEN len(list_filter(d, lambda x: starts_with(x, '.') OR starts_with(x, 'cmake-build-') OR x IN ({_quoted(SKIPPED)}))) = 0 THEN name END AS n,
        lower(regexp_extract(name, '.[.]([^.]+)$', 1)) AS e, len(list_filter(d, lambda x: x IN ({_quoted(LOW_PRIORITY)}))) > 0 AS low, len(d) = 0 AS root FROM p),
      s AS (SELECT * EXCLUDE (k), root_markers * 40 + (k - root_markers) * 12 + priority_files * 3 + total_files AS score FROM ({_LANG_SQL}))
    SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY score DESC, language) AS rank FROM s
    WHERE score > 0 OR language = 'typescript' AND scope_key NOT IN (SELECT scope_key FROM s WHERE score > 0)""")
def repository_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages of every repository by its paths; the first is its primary one."""
    c = table(spark, d, "commit_files").where((F.col("path") != "") & F.col("scope_key").isNotNull())
    return language_scores(c, ["scope_key"])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.concat_ws("#", "path", "doc_id").alias("file"), "text")


_LINES = "li AS (SELECT concat_ws('#', path, doc_id::VARCHAR) AS file, unnest(regexp_split_to_array(text, '\\r?\\n')) AS t, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS line FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_LINES}, e AS (SELECT file, line, unnest(regexp_extract_all(t, '{EQUAL}')) AS m FROM li)
    SELECT file, line::INT AS line, regexp_extract(m, '"([^"]+)"', 1) AS value FROM e
    UNION ALL SELECT file, line::INT, unnest(regexp_extract_all(t, '{CASE}', 1)) FROM li
    UNION ALL SELECT file, line::INT, unnest(regexp_extract_all(t, '{CASE_MEMBER}', 1)) FROM li""")
def literal_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons with literals in the corpus' texts."""
    return comparisons(_texts(spark, d))


@query()
def literal_dispersion(spark: SparkSession, d: str) -> DataFrame:
    """Values of discriminator types that are compared in several files."""
    t = _texts(spark, d)
    return across_modules(dispersion(discriminators(t), comparisons(t)))


# --- projects of several modules -------------------------------------------------


def cross_module(modules: DataFrame, declared: DataFrame) -> DataFrame:
    """(module, target): dependencies between the modules of a workspace. `modules` has (module, artifact), `declared` (module, dependency)."""
    a = modules.select(F.col("module").alias("target"), F.col("artifact").alias("dependency"))
    return declared.join(a, "dependency").where(F.col("module") != F.col("target")).select("module", "target").distinct()


#: Frameworks and the beginnings of the imports that show them (fixed values).
FRAMEWORKS = {"gin": "github.com/gin-gonic/gin", "echo": "github.com/labstack/echo", "chi": "github.com/go-chi/chi", "grpc": "google.golang.org/grpc", "cobra": "github.com/spf13/cobra", "net/http": "net/http"}


def frameworks(imports: DataFrame, column: str = "path") -> DataFrame:
    """Imports with the framework they belong to; the rest is left out."""
    out = F.lit(None).cast("string")
    for name, prefix in FRAMEWORKS.items():
        out = F.when((F.col(column) == prefix) | F.startswith(column, F.lit(prefix + "/")), name).otherwise(out)
    return imports.withColumn("framework", out).where(F.col("framework").isNotNull())


def module_graph(imports: DataFrame) -> DataFrame:
    """(source, target, strength, names): imports between modules, how many there are and which different names they bring. `imports` has (source, target, name)."""
    return imports.where(F.col("source") != F.col("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("strength"), F.sort_array(F.collect_set("name")).alias("names"))


def without_generics(kind: Column) -> Column:
    """A type's name without what stands in its angle brackets."""
    return F.trim(F.split(kind, "<")[0])


def label(name: Column, width: int = 40) -> Column:
    """A directory as a label: words with capitals, cut to a width."""
    words = F.initcap(F.regexp_replace(name, r"[-_./]+", " "))
    return F.when(F.length(words) > width, F.concat(F.substring(words, 1, width - 1), F.lit("…"))).otherwise(words)
