from strataspark.functions.test_texts import test_structure as structure

FILES = {
    "src/a.test.ts": ("import { it } from 'vitest';\nit('x', () => {\n  expect(1).toBe(1);\n  assert.ok(2);\n});\nit.skip('y', () => {});\ntest('z', f);\n", ("typescript", ["vitest"], 2, 2, 0, "unit")),
    "t/e2e/b.spec.tsx": ("test('only', () => {});", ("typescript", ["unknown"], 1, 0, 0, "debug")),
    "t/perf/c.test.js": ("xit('p', () => {});\nit('q')", ("typescript", ["unknown"], 1, 0, 0, "performance")),
    "t/integration/d.test.ts": ("it('a', () => { expect(1) })\r\ntest('b', () => { expect(2) })\r\n", ("typescript", ["unknown"], 2, 2, 0, "integration")),
    "ATest.java": (
        "import org.junit.jupiter.api.Test;\nimport org.assertj.core.api.X;\nclass A {\n  @Test\n  void one() { assertEquals(1, 1); assertTrue(x); }\n\n  @Disabled\n  @Test\n  public void two() { Assertions.assertNull(y); }\n  void helper() {}\n}\n",
        ("java", ["junit5", "assertj"], 2, 4, 1, "unit"),  # 1.5 each, rounded to 2
    ),
    "BBench.java": ("import org.openjdk.jmh.annotations.Benchmark;\nclass B {\n  @Benchmark\n  public void run() {}\n}\n", ("java", ["jmh"], 1, 0, 0, "performance")),
    "C.java": ("import org.junit.Test;\nclass C {\n  @Test\n  // why\n  public void a() {}\n}", ("java", ["junit4"], 1, 0, 0, "debug")),
    "NoFramework.java": ("@Test\nvoid a() {}", None),
    "test_a.py": ("import pytest\n\n@pytest.mark.skip\ndef test_a():\n    assert 1\n\n\ndef test_b():\n    assert(2)\n    self.assertEqual(1, 1)\n", ("python", ["pytest"], 2, 5, 1, "unit")),
    "test_b.py": ("def check():\n    assert 1\n    assert 2\n    assert 3\n\ndef test_x():\n    check()\n\ndef test_y():\n    check()\n", ("python", ["unknown"], 2, 4, 0, "unit")),  # none in the bodies: 1.5 each, rounded up
    "x/benchmark/test_c.py": ("from unittest import T\nclass A:\n    def test_m(self):\n        pass", ("python", ["unittest"], 1, 0, 0, "performance")),
    "a_test.cpp": ('#include <gtest/gtest.h>\nTEST(S, one) { EXPECT_EQ(1, 1); }\nTEST_F(F, two) { ASSERT_TRUE(x); }', ("cpp", ["gtest"], 2, 2, 0, "unit")),
    "b_test.cc": ('#include <catch2/catch.hpp>\nTEST_CASE("one") { REQUIRE(1); }\nSCENARIO("two") {}', ("cpp", ["catch2"], 2, 1, 0, "unit")),
    "test-c.cpp": ("static void test_a() { assert(1); }\nbool verify_b() { }\nint main() { test_a(); }", ("cpp", ["assert"], 2, 1, 0, "unit")),
    "test-d.cpp": ("int main() { return 0; }", ("cpp", ["assert"], 1, 0, 0, "debug")),
    "KTest.kt": ("class K {\n  @Test\n  fun `a b`() { assertEquals(1, 1) }\n\n  @Ignore\n  @Test\n  fun two() { verify(x) }\n}", ("kotlin", ["unknown"], 2, 2, 1, "unit")),
    "a_test.go": (
        'import (\n\t"testing"\n\t"github.com/stretchr/testify/assert"\n)\nfunc TestA(t *testing.T) {\n\tassert.True(t, x)\n}\nfunc TestB(t *testing.T) {\n\tt.Skip("later")\n}\nfunc BenchmarkC(b *testing.B) {\n}\n',
        ("go", ["testify"], 3, 2, 1, "performance"),
    ),
    "b_test.go": ("func TestA(t *testing.T) {\n\tt.Fatalf(\"x\")\n}\nfunc helper() {}", ("go", ["testing"], 1, 1, 0, "unit")),
    "empty.test.ts": ("", None), "null.test.ts": (None, None), "readme.md": ("it('x')", None),
}


def test_all_languages(spark):
    df = spark.createDataFrame([(f, t, "clash") for f, (t, _) in FILES.items()], "file string, text string, language string")
    got = {r.file: (r.language, r.frameworks, r.cases, r.assertions, r.skips, r.test_type) for r in structure(df).collect()}
    want = {f: w for f, (_, w) in FILES.items() if w}
    assert {f: got.get(f) for f in want} == want and set(got) == set(want)
    assert structure(df.limit(0)).count() == 0
