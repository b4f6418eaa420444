"""What the texts of test files hold, in six languages: frameworks, cases, assertions, skipped cases and kind. All in the JVM.

Each language has its own way of writing tests, and its own count: assertions
by line in TypeScript and Python, by call elsewhere; in Python those of the 29
lines after a test's first one; in Go all of the file's for every test that is
no benchmark, as helpers assert; in Java as many for each test, rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import basename
from strataspark.plans.registry import register
from strataspark.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

#: Frameworks and what shows them, by language; what counts if none does (fixed values).
FRAMEWORKS = {
    "typescript": ([
        ("vitest", r"""from ['"]vitest['"]"""), ("jest", r"""from ['"]@jest/|require\(['"]jest['"]\)|jest\.fn\("""), ("mocha", r"""from ['"]mocha['"]|require\(['"]mocha['"]\)"""),
        ("jasmine", r"jasmine\.(describe|it|expect)\("), ("playwright", r"""from ['"]@playwright/test['"]"""), ("cypress", r"""from ['"]cypress['"]"""), ("@testing-library", r"""from ['"]@testing-library/"""),
    ], "unknown"),
    "java": ([
        ("junit5", r"import\s+org\.junit\.jupiter\.api\b"), ("junit4", r"(?s)\A(?!.*import\s+org\.junit\.jupiter\.api\b).*import\s+org\.junit\b"), ("testng", r"import\s+org\.testng\.annotations\b"),
        ("jmh", r"import\s+org\.openjdk\.jmh\.annotations\b"), ("assertj", r"import\s+org\.assertj\.core\.api\b"),
    ], None),
    "python": ([("pytest", r"(?m)^import pytest\b|^from pytest\b"), ("unittest", r"(?m)^import unittest\b|^from unittest\b")], "unknown"),
    "cpp": ([("gtest", r"#include\s*[<\"]gtest/gtest"), ("catch2", r"#include\s*[<\"]catch2/|CATCH_CONFIG_MAIN"), ("doctest", r"#include\s*[<\"]doctest\.h")], "assert"),
    "kotlin": ([], "unknown"),
    "go": ([("testify", r"import\s*\([^)]*testify/(?:assert|require)"), ("testing/quick", r"import\s*\([^)]*testing/quick")], "testing"),
}
#: Calls that assert, by language (fixed values).
ASSERTS = {
    "java": [r"\bAssert(?:ions)?\.\s*assert\w+\s*\(", r"\bassert(?:Equals|True|False|NotNull|Null|That|Throws|Same|NotSame)\s*\("],
    "kotlin": [
        r"\b(?:assertEquals|assertNotEquals|assertTrue|assertFalse|assertNull|assertNotNull)\s*\(", r"\b(?:assertThat|assertThrows|assertDoesNotThrow|assertTimeout)\s*\(",
        r"\b(?:verify|verifyNoMoreInteractions|verifyZeroInteractions)\s*\(", r"\b(?:expect|shouldBe|shouldNotBe|shouldBeNull|shouldNotBeNull)\s*\(", r"\b(?:shouldContain|shouldHaveSize|shouldBeEmpty|shouldBeInstanceOf)\s*\(",
    ],
    "cpp": [r"\bassert\s*\(", r"\bassert_\w+\s*\(", r"\bt\.assert_\w+\s*\(", r"\bGGML_ASSERT\s*\(", r"\bLLAMA_ASSERT\s*\(", r"\bEXPECT_\w+\s*\(", r"\bASSERT_\w+\s*\(", r"\bREQUIRE\s*\(", r"\bCHECK\s*\("],
    "go": [r"\bassert\.\w+\s*\(", r"\brequire\.\w+\s*\(", r"\bt\.(?:Error|Errorf|Fatal|Fatalf|Fail|FailNow)\s*\("],
}
#: Texts in lines that assert or skip, by language (fixed values).
LINES = {"typescript": ("expect(", "assert(", "assert."), "python": ("assert ", "assert(", ".assert")}
TS_SKIPS = ("it.skip(", "test.skip(", "xit(", "xtest(", "it.todo(", "test.todo(", "describe.skip(")
#: Lines after a test of Python in which its assertions lie (fixed value).
PY_BODY = 29
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "java": "java", "py": "python", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "kt": "kotlin", "kts": "kotlin", "go": "go"}

_TS_CASE = r"\bit\s*\(|\btest\s*\("
# annotations, comments and empty lines before a method, and the method's first line
_ANNOTATED = r"(?m)(?:^[ \t]*(?:@[^\n]*|//[^\n]*|\*[^\n]*|)\n)+[^\n@]*\b\w+\s*[(<]"
_ANNOTATED_KT = r"(?m)(?:^[ \t]*(?:@[^\n]*|//[^\n]*|)\n)+[^\n@]*\bfun\s+(?:`[^`]+`|\w+)\s*[(<]"
_PY_CASE = r"(?m)(?:^[ \t]*(?:[@#][^\n]*|)\n)*^[ \t]*def\s+test_\w+\s*\("
_GO_CASE = r"(?m)^func\s+(?:Test|Benchmark|Example|Fuzz)\w*\s*\([^{]*\{[^}]*"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _any(line: Column, texts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | F.contains(line, F.lit(t))
    return out


def _sum(counts: list[Column]) -> Column:
    out = F.lit(0)
    for c in counts:
        out = out + c
    return out


def _figures(language: str, t: Column) -> tuple[Column, Column, Column]:
    """(cases, assertions, skips) of a text."""
    lines = F.split(t, "\n")
    calls = _sum([F.size(_all(t, p)) for p in ASSERTS.get(language, [])])
    if language == "typescript":
        cases = F.filter(lines, lambda x: x.rlike(_TS_CASE))
        return F.size(cases), F.size(F.filter(lines, lambda x: _any(x, LINES[language]))), F.size(F.filter(cases, lambda x: _any(x, TS_SKIPS)))
    if language == "java":
        found = F.filter(_all(t, _ANNOTATED), lambda b: b.rlike(r"(?m)^\s*@(?:Test|Benchmark)\b"))
        n = F.size(found)
        return n, F.when(n > 0, n * F.floor(calls / n + 0.5)).otherwise(0), F.size(F.filter(found, lambda b: b.rlike(r"(?m)^\s*@(?:Ignore|Disabled)\b")))
    if language == "kotlin":
        found = F.filter(_all(t, _ANNOTATED_KT), lambda b: b.rlike(r"(?m)^\s*@(?:Test|ParameterizedTest|RepeatedTest)\b"))
        return F.size(found), calls, F.size(F.filter(found, lambda b: b.rlike(r"(?m)^\s*@(?:Ignore|Disabled)\b")))
    if language == "python":
        found = _all(t, _PY_CASE)
        n = F.size(found)
        asserts = F.transform(lines, lambda x: _any(x, LINES[language]).cast("int"))
        starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*def\s+test_\w+\s*\("), i)), lambda i: i.isNotNull())
        add = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
        inside = add(F.transform(starts, lambda i: add(F.slice(asserts, i + 2, F.lit(PY_BODY)))))
        whole = add(asserts)
        fallback = F.when(n > 0, F.ceil(whole / n) * n).otherwise(0)
        return n, F.when(inside > 0, inside).otherwise(fallback), F.size(F.filter(found, lambda b: b.rlike(r"(?m)^\s*(?:@pytest\.mark\.skip|@unittest\.skip|@skip\()")))
    if language == "cpp":
        gtest, named = F.size(_all(t, r"\bTEST(?:_F|_P)?\s*\(\s*\w+\s*,\s*\w+\s*\)")), F.size(_all(t, r"\b(?:TEST_CASE|SCENARIO)\s*\(\s*\"[^\"]+\""))
        own = F.size(_all(t, r"(?m)^(?:static\s+)?(?:void|bool|int)\s+(?:test|verify|check)_?\w*\s*\("))
        main = F.when(t.rlike(r"\bint\s+main\s*\("), 1).otherwise(0)
        by_name = t.rlike(FRAMEWORKS["cpp"][0][1][1]) | t.rlike(FRAMEWORKS["cpp"][0][2][1])
        cases = F.when(t.rlike(FRAMEWORKS["cpp"][0][0][1]), gtest).when(by_name, named).when(own > 0, own).otherwise(main)
        return cases, calls, F.lit(0)
    found = _all(t, _GO_CASE)
    measured = F.size(F.filter(found, lambda b: F.startswith(b, F.lit("func")) & b.rlike(r"^func\s+Benchmark")))
    return F.size(found), (F.size(found) - measured) * calls, F.size(F.filter(found, lambda b: F.contains(b, F.lit("t.Skip"))))


def _hint(language: str, file: Column, t: Column, frameworks: Column) -> Column:
    """The kind of test that the path, or a benchmark in the text, tells of."""
    if language == "java":
        return F.when(F.array_contains(frameworks, "jmh") | F.lower(basename(file)).rlike("bench"), "performance").otherwise("unit")
    if language == "go":
        return F.when(t.rlike(r"(?m)^func\s+Benchmark\w*\s*\("), "performance").otherwise("unit")
    if language not in ("typescript", "python"):
        return F.lit("unit")
    ts = language == "typescript"
    e2e = file.rlike("/e2e/|/cypress/|/playwright/" if ts else "/e2e/|/cypress/")
    joint = file.rlike(r"/integration/|\.integration\.test\." if ts else "/integration/")
    return F.when(e2e, "e2e").when(joint, "integration").when(file.rlike("/perf/|/performance/|/benchmark/"), "performance").otherwise("unit")


def test_structure(files: DataFrame, key: str = "file", text: str = "text", language: str | None = None) -> DataFrame:
    """(file, language, frameworks, cases, assertions, skips, test_type) of test files, their language told by the extension if it is not given.

    Files without cases, of other languages, and those of Java without a
    framework are left out, as are null texts. Cases without any assertion make
    a debug test, unless it measures performance.
    """
    lang = F.lit(language)
    if language is None:
        ext, lang = F.lower(F.regexp_extract(F.col(key).cast("string"), r"\.(\w+)$", 1)), F.lit(None).cast("string")
        for e, name in EXTENSIONS.items():
            lang = F.when(ext == e, name).otherwise(lang)
    rows = files.select(F.col(key).alias("file"), F.regexp_replace(F.col(text), "\r\n", "\n").alias("t"), lang.alias("language")).where(F.col("t").isNotNull())
    out = None
    for name, (patterns, other) in FRAMEWORKS.items():
        if language not in (None, name):
            continue
        some = F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(f)) for f, p in patterns])) if patterns else F.array().cast("array<string>")
        if name == "go":  # testify stands in for the standard library, any other framework beside it
            some = F.when(F.array_contains(some, "testify"), some).otherwise(F.array_append(some, other))
        elif other is not None:
            some = F.when(F.size(some) == 0, F.array(F.lit(other))).otherwise(some)
        cases, assertions, skips = _figures(name, F.col("t"))
        part = rows.where(F.col("language") == name).withColumn("frameworks", some)
        part = part.select(
            "file", "language", "frameworks", cases.cast("bigint").alias("cases"), assertions.cast("bigint").alias("assertions"), skips.cast("bigint").alias("skips"), _hint(name, F.col("file").cast("string"), F.col("t"), F.col("frameworks")).alias("hint")
        )
        out = part if out is None else out.unionByName(part)
    found = out.where((F.col("cases") > 0) & (F.size("frameworks") > 0))
    kind = F.when((F.col("assertions") == 0) & (F.col("hint") != "performance"), "debug").otherwise(F.col("hint"))
    return found.withColumn("test_type", kind).drop("hint")


# --- queries -----------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS x FROM documents WHERE text IS NOT NULL),
      f AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(x, '\bit\s*\(|\btest\s*\(')) AS cases, count(*) FILTER (WHERE contains(x, 'expect(') OR contains(x, 'assert(') OR contains(x, 'assert.')) AS assertions,
        count(*) FILTER (WHERE regexp_matches(x, '\bit\s*\(|\btest\s*\(') AND regexp_matches(x, '(it|test|describe)\.skip\(|x(it|test)\(|(it|test)\.todo\(')) AS skips FROM l GROUP BY 1)
    SELECT doc_id, cases, assertions, skips, CASE WHEN assertions = 0 THEN 'debug' ELSE 'unit' END AS test_type FROM f WHERE cases > 0""")
def texts_like_tests(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the corpus that hold what would be test cases of TypeScript."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return test_structure(docs, "doc_id", "text", "typescript").select(F.col("file").alias("doc_id"), "cases", "assertions", "skips", "test_type")
