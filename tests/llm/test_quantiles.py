import datetime as dt
import math

import numpy as np
import pytest

from strataspark.functions.text import plain
from strataspark.llm.quantiles import Sketch, _seed, estimates, merge_sketches, sketches, valid_scores

QS = [1e-4, 0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 0.9999]


def worst(values, sketch):
    """The largest rank error as a share of the distance from the nearer end."""
    xs, n, out = np.sort(values), len(values), 0.0
    for q in QS:
        v, r = sketch.quantile(q), max(1, math.ceil(q * n))
        lo, hi = np.searchsorted(xs, v, "left") + 1, np.searchsorted(xs, v, "right")
        off = 0 if lo <= r <= hi else min(abs(r - lo), abs(r - hi))
        out = max(out, max(0, off - 1) / min(r, n - r + 1))
    return out


@pytest.mark.parametrize("parts,size", [(2000, 256), (5000, 193), (1000, 1000)])
@pytest.mark.parametrize("lie", ["strided", "sorted", "random", "alike"])
@pytest.mark.parametrize("at_once", [1, 40])
def test_error_limit_over_many_parts(parts, size, lie, at_once):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = np.sort(rng.random(parts * size))
        if lie == "alike":  # every part holds nearly the same values
            x = np.sort(np.tile(x[::parts], parts) + np.arange(parts).repeat(size) * 1e-12)
        cut = np.split(rng.permutation(x) if lie == "random" else x, parts) if lie in ("sorted", "random") else [x[i::parts] for i in range(parts)]
        whole, waiting = Sketch(), []
        for i, part in enumerate(cut):
            s = Sketch(seed=_seed(i, ("g",), part))
            s.add(part)
            waiting.append(s)
            if len(waiting) == at_once:
                whole.merge(*waiting)
                waiting = []
        whole.merge(*waiting)
        assert whole.n == len(x)
        assert worst(x, whole) < 0.02  # stated: 0.05


def test_equal_parts_draw_differently():
    x = np.arange(256.0)
    a, b = Sketch(seed=_seed(0, ("g",), x)), Sketch(seed=_seed(1, ("g",), x))
    assert a.low.seed != b.low.seed and a.low.seed != a.high.seed


def test_pack_keeps_everything():
    for n in (0, 5, 100_000):
        s = Sketch(seed=7)
        s.add(np.random.default_rng(n).random(n))
        t = Sketch.unpack(s.pack())
        assert t.pack() == s.pack() and t.low.times == s.low.times and all((p == q).all() for p, q in zip(t.high.levels, s.high.levels))
        more = np.random.default_rng(1).random(5000)
        s.add(more), t.add(more)
        assert s.pack() == t.pack()


@pytest.mark.parametrize("name", ["uniform", "sorted", "reversed", "ties", "one", "two_ends"])
def test_error_limit_over_merged_parts(name):
    rng = np.random.default_rng(4)
    x = rng.random(60_000)
    x = {"uniform": x, "sorted": np.sort(x), "reversed": np.sort(x)[::-1], "ties": np.round(x, 1), "one": np.ones(60_000), "two_ends": x > 0.999}[name].astype(float)
    whole = Sketch()
    for part in np.array_split(x, 97):
        s = Sketch()
        s.add(part)
        whole.merge(Sketch.unpack(s.pack()))
    assert whole.n == len(x)
    assert worst(x, whole) < 0.05
    assert len(whole.pack()) < 8 * len(x) / 3


def test_small_sketch_is_exact():
    s = Sketch()
    s.add(np.array([0.3, 0.1, 0.2]))
    assert [s.quantile(q) for q in (0.01, 0.5, 1.0)] == [0.1, 0.2, 0.3]
    assert math.isnan(Sketch().quantile(0.5))


def test_days_join_into_periods(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else None, dt.date(2025, 1, 1 + i % 20), float(v)) for i, v in enumerate(rng.random(3000))]
    rows += [("b", dt.date(2025, 1, 1), None), ("b", dt.date(2025, 1, 1), float("nan"))]
    df = spark.createDataFrame(rows, "g string, day date, v double").repartition(5)
    daily = sketches(df, ["g", "day"], "v")
    assert daily.count() == 40
    got = {r.g: r for r in estimates(merge_sketches(daily.drop("day"), ["g"]), [0.5, 0.99], ["g"]).collect()}
    assert set(got) == {"a", None} and got["a"].n == 2000
    xs = np.sort([v for g, _, v in rows if g == "a"])
    assert abs(np.searchsorted(xs, got["a"].p50) - 1000) < 60 and abs(np.searchsorted(xs, got["a"].p99) - 1980) <= 3
    assert estimates(sketches(df.limit(0), ["g"], "v"), [0.5], ["g"]).count() == 0


def test_rows_that_count(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [
        ("r1", " GPT\t", "Mermaid", dt.date(2025, 1, 1), 0.5, t),
        ("r1", "gpt", "mermaid ", dt.date(2025, 1, 1), 0.5, t + dt.timedelta(1)),
        ("r2", None, "mermaid", dt.date(2025, 1, 1), 0.5, t), ("r3", "gpt", " ", dt.date(2025, 1, 1), 0.5, t),
        ("r4", "gpt", "mermaid", None, 1.5, t), ("r5", "gpt", "mermaid", None, float("nan"), t), ("r6", "gpt", "mermaid", None, None, t),
        ("r7", "gpt", "mermaid", None, 1.0, None), (None, "gpt", "mermaid", None, 0.0, t), (None, "gpt", "mermaid", None, 0.0, t),
    ]
    df = spark.createDataFrame(rows, "result_id string, model string, format_name string, run_date date, mean_score double, ingested_at timestamp")
    got = valid_scores(df, plain).collect()
    assert sorted((r.result_id or "", r.mean_score) for r in got) == [("", 0.0), ("", 0.0), ("r1", 0.5), ("r7", 1.0)]
    assert {(r.model, r.format_name) for r in got} == {("gpt", "mermaid")}
