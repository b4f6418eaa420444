import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataspark.llm import leaks as lk

PASSAGE = "Within src/metrics/a.py, ModuleMerger28 holds 1937 outgoing association edges toward HealthRunner68 and BranchLoader17, then stops after 12 ms."


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_words_are_runs_of_letters_and_digits(text):
    low = unicodedata.normalize("NFKC", text).lower()
    assert lk.words(text) == "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in low).split()


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, passage string"),
        spark.createDataFrame(items, "item_id bigint, passage string, text string"),
    )


def test_leaks(spark):
    other = "Within src/metrics/a.py, HealthMerger5 holds 20 outgoing association edges toward BranchRunner6 and BranchLoader17, then stops after 9 ms."
    crossed = "Within src/metrics/a.py, HealthMerger5 holds 20 outgoing association edges toward HealthMerger5 and BranchLoader17, then stops after 9 ms."
    docs = [
        (1, "Intro. " + PASSAGE.upper() + " End.", None, None), (2, PASSAGE.replace(" ", "\n> **"), None, None), (3, " ".join(PASSAGE.split()[:8]), None, None),
        (4, other, None, None), (5, None, None, None), (6, "", None, None), (7, "x " * 50_000 + PASSAGE, None, None), (8, PASSAGE + PASSAGE, None, None), (8, PASSAGE + PASSAGE, None, None),
        (9, "Ｗｉｔｈｉｎ" + PASSAGE[6:], None, None), (10, " ".join(PASSAGE.split()[:6]), None, None), (11, " ".join(PASSAGE.split()[6:]), None, None), (12, crossed, None, None),
    ]
    items = [(100, PASSAGE, ""), (101, "Too short.", ""), (102, None, ""), (103, PASSAGE, ""), (None, PASSAGE, "")]
    d, i = frames(spark, docs, items)
    assert {tuple(r) for r in lk.leaks(d, i).collect()} == {(x, y) for x in (1, 2, 7, 8, 9) for y in (100, 103)}
    got = {r.doc_id: r for r in lk.reparameterised(d, i).collect()}
    assert got[4].template_windows > got[4].exact_windows == 0 and got[4].items == 2
    assert got[1].exact_windows > 0 == got[1].template_windows
    assert got[12].template_windows < got[4].template_windows  # one filling for two slots is no re-parameterisation
    assert lk.leaks(d.limit(0), i).count() == 0 and lk.leaks(d, i.limit(0)).count() == 0


def test_many_items_give_the_same(spark, monkeypatch):
    d, i = frames(spark, [(1, PASSAGE, None, None)], [(k, PASSAGE if k % 2 else "no", "") for k in range(7)])
    whole = {tuple(r) for r in lk.leaks(d, i).collect()}
    monkeypatch.setattr(lk, "ITEMS_BROADCAST", 2)
    assert {tuple(r) for r in lk.leaks(d, i).collect()} == whole == {(1, 1), (1, 3), (1, 5)}


def test_many_items_give_the_same_counts(spark, monkeypatch):
    other = "Within src/metrics/a.py, HealthMerger5 holds 20 outgoing association edges toward BranchRunner6 and BranchLoader17, then stops after 9 ms."
    docs = [(1, PASSAGE, None, None), (2, other, None, None), (2, other + " " + PASSAGE, None, None), (None, other, None, None)]
    items = [(1, PASSAGE, ""), (2, other, ""), (3, PASSAGE.replace("1937", "5"), ""), (4, "HealthRunner ModuleMerger", ""), (5, other.replace("20", "7"), "")]
    d, i = frames(spark, docs, items)
    whole = sorted(map(tuple, lk.reparameterised(d, i).collect()), key=str)
    monkeypatch.setattr(lk, "ITEMS_BROADCAST", 0)
    assert sorted(map(tuple, lk.reparameterised(d, i).collect()), key=str) == whole


def test_the_filter_rules_out_nothing_that_is_there(spark):
    t = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    index = spark.createDataFrame([(int(x),) for x in t.view(np.int64)], "__t bigint").repartition(3)
    bits = lk._filter(index)
    assert len(bits) == lk.FILTER and lk._passes(bits, t).all()
    assert lk._passes(bits, t ^ np.uint64(1 << 40)).mean() < 0.01


def test_a_real_corpus_by_both_ways(spark, data, monkeypatch):
    d, i = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "eval_items"))
    few = [sorted(map(tuple, f(d, i).collect())) for f in (lk.leaks, lk.reparameterised)]
    monkeypatch.setattr(lk, "ITEMS_BROADCAST", 10)
    assert [sorted(map(tuple, f(d, i).collect())) for f in (lk.leaks, lk.reparameterised)] == few


def both_ways(spark, monkeypatch, docs, items):
    d, i = frames(spark, [(*x, None, None) for x in docs], [(*x, "") for x in items])
    got = []
    for most in (2000, 0):
        monkeypatch.setattr(lk, "ITEMS_BROADCAST", most)
        got.append({r.doc_id: tuple(r)[1:] for r in lk.reparameterised(d, i).collect()})
    assert got[0] == got[1]
    return got[0]


def test_a_copy_of_one_item_may_refill_another(spark, monkeypatch):
    other = PASSAGE.replace("1937", "20").replace("ModuleMerger28", "HealthMerger5")
    third = PASSAGE.replace("1937", "7")
    n = len(lk.words(PASSAGE)) - lk.WINDOW + 1
    got = both_ways(spark, monkeypatch, [(1, PASSAGE)], [(1, PASSAGE), (2, other), (3, third), (4, PASSAGE)])
    exact, template, items = got[1]
    assert exact == n and items == 2
    assert template == sum("1937" in lk.words(PASSAGE)[at : at + lk.WINDOW] or "modulemerger28" in lk.words(PASSAGE)[at : at + lk.WINDOW] for at in range(n))


def test_names_that_no_item_holds_fill_slots(spark, monkeypatch):
    n = len(lk.words(PASSAGE)) - lk.WINDOW + 1
    fresh = PASSAGE.replace("ModuleMerger28", "QueueDrainer").replace("HealthRunner68", "HTTPPumpValve12").replace("BranchLoader17", "xAxis").replace("1937", "4").replace("12 ms", "3 s")
    doubled = fresh.replace("xAxis", "QueueDrainer")
    long = PASSAGE.replace("ModuleMerger28", "ModuleHealthMerger28")
    got = both_ways(spark, monkeypatch, [(1, fresh), (2, fresh.lower()), (3, doubled), (4, long.lower().replace("modulehealthmerger28", "branchloader1"))], [(1, PASSAGE), (2, long)])
    assert got[1] == (0, n, 2)
    assert 2 not in got  # neither spelling nor items tell the names
    assert 0 < got[3][1] < n  # one filling for two slots
    assert got[4][2] == 2 and got[4][1] > 0


def test_a_word_of_an_item_in_camel_case(spark, monkeypatch):
    plain = PASSAGE.replace("outgoing", "queuedrainer")
    n = len(lk.words(plain)) - lk.WINDOW + 1
    docs = [(1, plain.replace("queuedrainer", "QueueDrainer")), (2, plain.replace("queuedrainer", "QueueDrainer").replace("ModuleMerger28", "QueueDrainer")), (3, plain.replace("queuedrainer", "KettleWasher"))]
    got = both_ways(spark, monkeypatch, docs, [(1, plain)])
    assert got[1] == (n, 0, 0)
    assert got[2][0] + got[2][1] == n and got[2][1] > 0
    assert 3 not in got or got[3][0] + got[3][1] < n  # a word that is none of the item's slots


def test_texts_of_one_key_are_counted_together(spark, monkeypatch):
    a, b = PASSAGE.split(" then ")[0] + " one two three", "one two three " + PASSAGE
    single = [both_ways(spark, monkeypatch, [(1, x)], [(1, PASSAGE)])[1][0] for x in (a, b)]
    assert both_ways(spark, monkeypatch, [(1, a), (1, b), (1, a)], [(1, PASSAGE)])[1][0] == sum(single) > max(single)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text("aB\u0130\u03a3 '.\u0307K\u212a1_I", max_size=40))
def test_spelling_has_the_same_words(text):
    assert [x.lower().replace("ς", "σ") for x in lk.spelled(text)] == [w.replace("ς", "σ") for w in lk.words(text)]


def counted(docs, items, names):
    """The rows by looking at every pair of windows."""
    plain = lk.Templates(names)
    vocabulary = {w for _, p in items for w in lk.words(p)}

    def slots(text):
        ws = lk.words(text)
        return [[plain.placeholder(w)] if x == w or not plain.named(x, w) else [lk.NAME] + [plain.placeholder(w)] * (w in vocabulary) for x, w in zip(lk.spelled(text), ws)], ws

    def windows(text):
        types, ws = slots(text)
        return [(types[at : at + lk.WINDOW], tuple(ws[at : at + lk.WINDOW])) for at in range(len(ws) - lk.WINDOW + 1)]

    def one_to_one(a, b):
        return len(set(a)) == len(set(b)) == len(set(zip(a, b)))

    known = [(i, tuple(plain.placeholder(x) for x in w), w) for i, p in items for _, w in windows(p)]
    out = {}
    for d, text in docs:
        exact = template = most = 0
        for types, w in windows(text):
            own = {i for i, _, v in known if v == w}
            by_template = {}
            for i, t, v in known:
                at = [k for k in range(lk.WINDOW) if t[k][0] == "\x00"]
                if all(t[k] in types[k] for k in range(lk.WINDOW)) and one_to_one([w[k] for k in at], [v[k] for k in at]):
                    by_template.setdefault(t, set()).add(i)
            n = max((len(x - own) if any(v == w and t == u for _, u, v in known) else len(x) for t, x in by_template.items()), default=0)
            exact, template, most = exact + bool(own), template + (n > 0), max(most, n)
        if exact or template:
            out[d] = (exact, template, most)
    return out


def test_counts_are_those_of_all_pairs_of_windows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pool = ["ModuleMerger", "HealthRunner5", "BranchRunner", "holds", "7", "12", "ms", "kb"]
    more = [*pool, "QueueDrainer", "Holds", "HoLds", "holDs", "kB", "healthmerger", "ModuleHealthRunner", "PumpValve9"]
    items = [(k, " ".join(rng.choice(pool, 4).tolist() * 4)) for k in range(12)]
    docs = [(k, " ".join(rng.choice(more, 4).tolist() * 4) if k % 4 else items[k % 12][1]) for k in range(60)]
    docs += [(100 + k, " ".join({"ModuleMerger": "QueueDrainer", "7": "99", "holds": "HoLds"}.get(w, w) for w in p.split())) for k, p in items]
    got = both_ways(spark, monkeypatch, docs, items)
    assert got == counted(docs, items, lk.name_parts([p for _, p in items]))
    assert sum(t for _, t, _ in got.values()) > 50 and sum(e for e, _, _ in got.values()) > 50
