import json

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataspark.operators import flatten


def brute(payload):
    """All objects of a payload by walking it."""
    while isinstance(payload, str):
        try:
            payload = json.loads(payload.removeprefix("﻿"))
        except ValueError:
            return
    if not isinstance(payload, dict):
        return
    sub = lambda v, k: v.get(k) if isinstance(v, dict) else None

    def each(v, above=""):
        for i, x in enumerate(v if isinstance(v, list) else [v] if isinstance(v, dict) else []):
            if isinstance(x, dict):
                yield above + str(i), x

    for e, x in each(payload.get("entities")):
        yield "entity", e
        for m, y in each(x.get("methods"), e + "."):
            yield "method", m
            for p, _ in each(y.get("params"), m + "."):
                yield "param", p
        for o, _ in each(x.get("outgoing"), e + "."):
            yield "outgoing", o
    layers = sub(sub(sub(payload, "extensions"), "goAtlas"), "layers")
    for kind, at in flatten.TOP.items():
        if kind == "entity":
            continue
        for c, x in each(sub(sub(layers, at[-2]), at[-1])):
            yield kind, c
            if kind == "call_chain":
                for k, _ in each(x.get("calls"), c + "."):
                    yield "call_edge", k


ALL_FIELDS = {k: tuple(f) for k, f in flatten.FIELDS.items()}


def operator(payloads, wanted=flatten.NO_FIELDS):
    out = []
    for kind, lv in flatten.levels(payloads, pa.array(range(len(payloads)), pa.int64()), flatten.Shape(wanted)).items():
        out += zip(lv.record.to_pylist(), [kind] * len(lv.path), lv.path.to_pylist())
    return sorted(out)


ODD = [
    None, "", "null", "7", "not json", "{}", "[]", '{"entities": [', '{"entities": null}', '{"entities": {"id": "a", "methods": {"name": "m", "params": {"name": "p"}}}}',
    '﻿{"entities": [null, {"methods": [null, {"params": [null, {}]}], "outgoing": [{}, null, 5, "x", [{}]]}]}',
    json.dumps('﻿{"entities": [{"id": 3, "name": true, "outgoing": {"targetId": 9}}]}'), json.dumps(json.dumps({"entities": [{}]})),
    '{"entities": [{"id": "\\ud800", "name": "ok"}]}', '{"entities": 5, "extensions": {"goAtlas": {"layers": {"package": {"nodes": [{"fileCount": "many"}], "edges": {"strength": 1e400}}, "flow": {"callChains": [{"calls": [null, {"confidence": 1}]}, null]}}}}}',
    '{"entities": [{}]}{"entities": [{}]}', '{"entities": [{}]}}\n{"p": {"entities": [{}]}', '{"entities": [{}], "entities": [{}, {}]}', '{"entities": [{"id": "a\nb"}]}', ' \n{"entities":\n [{}\n]}\n', '{"entities": [{"id": "x", "id": "y"}]}',
    '{"entities": [{"name": NaN}]}', '{"extensions": {"goAtlas": {"layers": {"package": {"nodes": [{"fileCount": 1.5}, {"fileCount": 99999999999999999999}, {"stats": [1]}]}}}}}', '{"extensions": []}', '{"entities": [[{}]]}', '{"entities": [{"id": "methods\\": {"}]}',
    '{"extensions": {"goAtlas": {"layers": {"package": [], "capability": {"nodes": {"exported": true}}, "goroutine": {"nodes": [{"location": {"line": 3}}]}}}}} ', '{"entities": []} x',
]


def nest(depth, text='{"entities": [{}]}'):
    for _ in range(depth):
        text = json.dumps(text)
    return text


@pytest.mark.parametrize("wanted", [flatten.NO_FIELDS, ALL_FIELDS])
def test_odd_payloads_equal_brute_force(wanted):
    assert operator(ODD, wanted) == sorted((i, k, p) for i, t in enumerate(ODD) for k, p in brute(t))


@pytest.mark.parametrize("depth", [1, 7, 8, 12])
def test_any_number_of_wrappings(depth):
    assert operator([nest(depth)]) == [(0, "entity", "0")]


def test_order_and_paths_by_either_way():
    good, lone, broken = '{"entities": [{"id": "%d", "methods": [{}]}]}', '{"entities": [{"id": "%d", "methods": {}}]}', '{"entities": [{"id": "%d"}'
    payloads = [(good, lone, broken)[i * i % 3 if i % 7 else 2] % i for i in range(300)]
    lv = flatten.levels(payloads, pa.array(range(300), pa.int64()), flatten.Shape(ALL_FIELDS))["entity"]
    assert [str(r) for r in lv.record.to_pylist()] == pc.struct_field(lv.objects, "id").to_pylist()
    assert len(lv.path) == sum(p.endswith("]}") for p in payloads)


def test_regular_payloads_are_not_decoded_in_python(monkeypatch):
    monkeypatch.setattr(flatten, "decode", lambda p: pytest.fail("decoded"))
    payload = json.dumps({"entities": [{"id": "a", "x": 1, "methods": [{"name": "m", "params": [None, {"name": "p"}]}], "outgoing": None}], "extensions": {"goAtlas": {"layers": {"flow": {"callChains": [{"calls": [{"from": "a"}]}]}}}}})
    assert len(operator([payload] * 40, ALL_FIELDS)) == 40 * 5


leaf = st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3)
names = st.sampled_from(["entities", "methods", "params", "outgoing", "id", "name", "targetId", "extensions", "goAtlas", "layers", "flow", "callChains", "calls", "package", "nodes"])
values = st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(names, x, max_size=4), max_leaves=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(names, values, max_size=4).map(json.dumps) | st.text(max_size=4), max_size=4))
def test_any_payloads_equal_brute_force(payloads):
    assert operator(payloads) == sorted((i, k, p) for i, t in enumerate(payloads) for k, p in brute(t))


def test_flat_tables_keep_parents(spark):
    rows = [(i, p, "clash") for i, p in enumerate(ODD)]
    df = spark.createDataFrame(rows, "raw_id bigint, payload string, path string")
    assert sorted(map(tuple, flatten.found(df).collect())) == operator(ODD)
    methods = {(r.raw_id, r.path) for r in flatten.flat(df, "method").collect()}
    params = flatten.flat(df, "param").collect()
    assert params and all((r.raw_id, r.parent_path) in methods for r in params)
    out = {(r.raw_id, r.path): r.target_id for r in flatten.flat(df, "outgoing").collect()}
    assert out[(11, "0.0")] == "9"
    assert {(r.raw_id, r.target_id, r.path) for r in flatten.targets(df, "path").collect()} == {(i, t, "clash") for (i, _), t in out.items()}
    for kind in flatten.KINDS:
        assert flatten.flat(df.limit(0), kind).count() == 0


@pytest.mark.parametrize("kind", flatten.KINDS)
def test_every_kind_has_columns(kind):
    assert flatten.COLUMNS[kind]
