import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strataspark.operators.graph import callers, components, degrees, reachable


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def brute(pairs):
    """Least member by vertex, for vertices on cycles of more than one vertex."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reach(v):
        out, todo = set(), [v]
        while todo:
            for w in after.get(todo.pop(), ()):
                if w not in out:
                    out.add(w)
                    todo.append(w)
        return out

    r = {v: reach(v) for v in after}
    same = {v: {w for w in r[v] if v in r.get(w, ())} | {v} for v in r}
    return {v: min(s) for v, s in same.items() if len(s) > 1}


CASES = [
    [], [("a", "a")], [("a", "b"), ("b", "c")], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "a"), ("d", "f"), ("f", "f")],
    [(f"{i:02}", f"{(i + 1) % 20:02}") for i in range(20)] + [("05", "z1"), ("z1", "z2"), ("z2", "z1")], list(itertools.permutations("abcd", 2)), [("b", "c"), ("c", "b"), ("a", "b"), ("a", "c"), ("x", "a")],
]


def test_components(spark):
    for pairs in CASES:
        for local_edges in (0, 100):
            got = {r.key: r.component for r in components(edges(spark, pairs + pairs), local_edges).collect()}
            assert got == brute(pairs), pairs


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=16))
def test_any_components(spark, pairs):
    assert {r.key: r.component for r in components(edges(spark, pairs)).collect()} == brute(pairs)


def test_reachable(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "c"), ("a", "b")])
    starts = spark.createDataFrame([("a",), (None,), ("unknown",)], "key string")
    assert {tuple(r) for r in reachable(e, starts, 2).collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert reachable(e, starts, 99).count() == 4
    assert reachable(e, starts.limit(0), 2).count() == 0


def test_callers_may_recur_on_deeper_levels(spark):
    calls = spark.createDataFrame([("x", "t", "m", "run"), ("x", "t", "n", "stop"), ("t", "x", "k", "m"), ("y", "x", None, "m")], "src string, dst string, source_method string, target_method string")
    got = [tuple(r) for r in callers(calls, spark.createDataFrame([("t",)], "key string"), 3, "run").collect()]
    assert sorted(got, key=str) == sorted([("x", "m", 1), ("t", "k", 2), ("y", None, 2), ("x", "m", 3), ("x", "n", 3)], key=str)


def test_degrees_count_edges(spark):
    got = {r.key: (r.in_degree, r.out_degree) for r in degrees(edges(spark, [("a", "b"), ("a", "b"), ("b", "b")])).collect()}
    assert got == {"a": (0, 2), "b": (3, 1)}


def test_all_shared_entities_are_starts(spark, data):
    from strataspark.operators import graph as g
    from strataspark.sources.graph import edges as resolved

    starts = {r.key for r in g.shared_starts(spark, data).collect()}
    assert {"commonlib.core.sessionplanner3", "commonlib.mcp.tokenplanner11"} <= starts
    es = [(r.src, r.dst, r.rel_type, r.source_method) for r in resolved(spark, data).collect()]
    depth, frontier = {}, starts
    for level in (1, 2, 3):
        frontier = {a for a, b, _, _ in es if b in frontier} - starts - set(depth)
        depth |= {k: level for k in frontier}
    assert {r.key: r.depth for r in g.dependents(spark, data).collect()} == depth
    want, frontier = [], starts
    for level in (1, 2):
        hits = {(a, m) for a, b, t, m in es if t == "call" and b in frontier}
        want += [(a, m, level) for a, m in hits]
        frontier = {a for a, _ in hits}
    assert sorted(map(tuple, g.find_callers(spark, data).collect()), key=str) == sorted(want, key=str)
