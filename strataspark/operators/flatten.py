"""Nested raw records as related flat tables.

Payloads are decoded by Arrow's JSON reader, many at once, into nested arrays
that hold only the lists and fields a query asks for; every child table then
comes out of the list offsets: `list_flatten` gives the children of all records
of a batch at once, `list_parent_indices` the parent of each, and the keys of
the parents travel down by `take`. No such record is parsed or walked in Python.

The reader takes no payload that is broken, wrapped in a string, or departs
from the schema (a single object where a list belongs, other types in fields,
keys given twice). It tells the row it stops at; these payloads alone are
decoded and put into shape one by one, and join the others before flattening.
"""

from __future__ import annotations

import io
import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame

S, I, D, B = pa.string(), pa.int64(), pa.float64(), pa.bool_()
#: Fields of the objects of each kind, without the lists of other kinds in them.
FIELDS = {
    "entity": {"id": S, "name": S, "type": S, "sourceFile": S},
    "method": {"name": S, "returnType": S},
    "param": {"name": S, "type": S},
    "outgoing": {"relType": S, "targetId": S},
    "package_node": {"id": S, "name": S, "type": S, "fileCount": I, "stats": pa.struct({"structs": I, "interfaces": I, "functions": I})},
    "package_edge": {"source": S, "target": S, "strength": I},
    "capability_node": {"id": S, "name": S, "package": S, "type": S, "exported": B},
    "goroutine_node": {"id": S, "name": S, "package": S, "type": S, "location": pa.struct({"file": S, "line": I})},
    "call_chain": {"id": S, "entryPoint": S},
    "call_edge": {"from": S, "to": S, "type": S, "confidence": D},
}
#: Kind -> where its outermost list lies in a record.
TOP = {
    "entity": ("entities",),
    "package_node": ("extensions", "goAtlas", "layers", "package", "nodes"),
    "package_edge": ("extensions", "goAtlas", "layers", "package", "edges"),
    "capability_node": ("extensions", "goAtlas", "layers", "capability", "nodes"),
    "goroutine_node": ("extensions", "goAtlas", "layers", "goroutine", "nodes"),
    "call_chain": ("extensions", "goAtlas", "layers", "flow", "callChains"),
}
#: Kind -> (kind of the parent, field of the parent that holds the list).
CHILDREN = {
    "method": ("entity", "methods"),
    "param": ("method", "params"),
    "outgoing": ("entity", "outgoing"),
    "call_edge": ("call_chain", "calls"),
}
KINDS = ("entity", "method", "param", "outgoing", "package_node", "package_edge", "capability_node", "goroutine_node", "call_chain", "call_edge")
#: All objects, and no field of theirs.
NO_FIELDS: dict[str, tuple[str, ...]] = {k: () for k in KINDS}

#: A payload that may hold a single object in place of a list; the reader would stop there.
_LONE = re.compile(r'"(?:' + "|".join(sorted({at[-1] for at in TOP.values()} | {f for _, f in CHILDREN.values()})) + r')"\s*:\s*\{')
#: The name of the row number beside a payload; drawn anew in each process, so that no payload can pretend to be several rows.
_ROW = uuid.uuid4().hex
_STOPPED = re.compile(r"in row (\d+)")


def decode(payload: str | None) -> dict | None:
    """The one complete JSON object of a payload, or None.

    A byte order mark in front is ignored and a JSON string stands for the
    JSON in it, both also inside such a string, however often it is wrapped.
    """
    while isinstance(payload, str):  # a string is longer than what is in it, so this ends
        try:
            payload = json.loads(payload.removeprefix("\ufeff"))
        except (ValueError, RecursionError):
            return None
    return payload if isinstance(payload, dict) else None


def _sub(value: object, *names: str) -> object:
    for n in names:
        value = value.get(n) if isinstance(value, dict) else None
    return value


class Shape:
    """The Arrow types of the wanted objects of a record: kind -> its wanted fields. Parents of wanted kinds come with their lists only."""

    def __init__(self, wanted: dict[str, tuple[str, ...]]):
        self.wanted = wanted
        self.top = [k for k in TOP if self._needed(k)]
        self.record = pa.struct([(k, self._list(k)) for k in self.top])
        tree: dict = {}
        for k in self.top:
            at = tree
            for name in TOP[k][:-1]:
                at = at.setdefault(name, {})
            at[TOP[k][-1]] = self._list(k)
        self.schema = pa.schema([(_ROW, I), ("p", self._tree(tree))])

    def _needed(self, kind: str) -> bool:
        return kind in self.wanted or any(self._needed(c) for c, (up, _) in CHILDREN.items() if up == kind)

    def _list(self, kind: str) -> pa.DataType:
        own = [(f, FIELDS[kind][f]) for f in self.wanted.get(kind, ())]
        return pa.list_(pa.struct(own + [(f, self._list(c)) for c, (up, f) in CHILDREN.items() if up == kind and self._needed(c)]))

    def _tree(self, tree: dict) -> pa.DataType:
        return pa.struct([(k, self._tree(v) if isinstance(v, dict) else v) for k, v in tree.items()])

    def _parse(self, lines: list[bytes]) -> pa.StructArray | None:
        """Payloads as records, None if they do not make as many rows."""
        data = b"\n".join(lines)
        read = pj.read_json(
            io.BytesIO(data),
            read_options=pj.ReadOptions(use_threads=False, block_size=len(data) + 1),
            parse_options=pj.ParseOptions(explicit_schema=self.schema, unexpected_field_behavior="ignore"),
        )
        if read.num_rows != len(lines) or read.column(0).null_count or np.any(np.diff(read.column(0).to_numpy()) != 1):
            return None
        p = read.column(1).combine_chunks()
        p = pa.concat_arrays(p.chunks) if isinstance(p, pa.ChunkedArray) else p
        return pa.StructArray.from_arrays([pc.struct_field(p, list(TOP[k])) for k in self.top], fields=list(self.record))

    def _read(self, lines: list[bytes]) -> tuple[list[tuple[int, pa.StructArray]], list[int]]:
        """(first row, records) of what the reader takes, and the rows it does not."""
        good, bad, todo = [], [], [(0, len(lines))]
        while todo:
            lo, hi = todo.pop()
            if lo >= hi:
                continue
            at = None
            try:
                part = self._parse(lines[lo:hi])
                if part is not None:
                    good.append((lo, part))
                    continue
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
                if m := _STOPPED.search(str(e)):
                    at = lo + int(m[1])
            if hi - lo == 1:
                bad.append(lo)
            elif at is not None and at < hi:
                bad.append(at)
                todo += [(at + 1, hi), (lo, at)]
            else:
                todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        return good, bad

    def records(self, payloads: list[str | None]) -> pa.StructArray:
        """Payloads as one nested array; whatever gives no complete JSON object is null."""
        lines, of, others = [], [], []
        for i, p in enumerate(payloads):
            text = p.removeprefix("\ufeff") if p else ""
            if text.lstrip(" \t\r\n")[:1] == "{" and not _LONE.search(text):
                try:
                    lines.append(b'{"%s":%d,"p":%s}' % (_ROW.encode(), len(lines), text.encode()))
                    of.append(i)
                    continue
                except UnicodeEncodeError:
                    pass
            others.append(i)
        good, bad = [], []
        if lines:
            good, bad = self._read(lines)
        others += [of[i] for i in bad]
        place = [of[lo + i] for lo, part in good for i in range(len(part))] + others
        parts = [part for _, part in good] + [self._shaped([decode(payloads[i]) for i in others])]
        order = np.empty(len(place), np.int64)
        order[np.array(place, np.int64)] = np.arange(len(place))
        return pa.concat_arrays(parts).take(pa.array(order))

    def _shaped(self, records: list[dict | None]) -> pa.StructArray:
        """Decoded records in shape; text that is not valid Unicode (lone surrogates) has its bad characters replaced."""
        side_by_side = [None if r is None else {k: _sub(r, *TOP[k]) for k in self.top} for r in records]
        rows = [shaped(r, self.record) for r in side_by_side]
        try:
            return pa.array(rows, type=self.record)
        except UnicodeEncodeError:
            return pa.array([_clean(r) for r in rows], type=self.record)


def shaped(value: object, kind: pa.DataType) -> object:
    """A value in the shape of an Arrow type: a lone object becomes a list of one, other types of text their JSON, what fits nowhere null.

    Numbers with a fraction or beyond 64 bits where an integer belongs, and
    those beyond a double's range, fit nowhere: they become null.
    """
    if value is None:
        return None
    if pa.types.is_list(kind):
        items = value if isinstance(value, list) else [value] if isinstance(value, dict) else []
        return [shaped(x, kind.value_type) for x in items]
    if pa.types.is_struct(kind):
        return {f.name: shaped(value.get(f.name), f.type) for f in kind} if isinstance(value, dict) else None
    if pa.types.is_string(kind):
        return value if isinstance(value, str) else json.dumps(value)
    if pa.types.is_boolean(kind):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if pa.types.is_floating(kind):
        try:
            return float(value) if math.isfinite(value) else None
        except OverflowError:
            return None
    return value if isinstance(value, int) and -(2**63) <= value < 2**63 else None


def _clean(value: object) -> object:
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    if isinstance(value, list):
        return [_clean(v) for v in value]
    return {_clean(k): _clean(v) for k, v in value.items()} if isinstance(value, dict) else value


class Level:
    """The objects of one kind of a batch: their record, their path, and the struct array itself."""

    def __init__(self, record: pa.Array, path: pa.Array, parent: pa.Array, objects: pa.StructArray):
        self.record, self.path, self.parent, self.objects = record, path, parent, objects


def _down(lists: pa.ListArray, record: pa.Array, path: pa.Array | None) -> Level:
    """The children of lists. Their position is their place among all children less the offset of their list."""
    parent = pc.list_parent_indices(lists)
    child = pc.list_flatten(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths) if len(lists) else lengths
    place = pc.subtract(pa.array(np.arange(len(child))), pc.cast(starts.take(parent), pa.int64())).cast(S)
    above = path.take(parent) if path is not None else None
    own = pc.binary_join_element_wise(above, place, ".") if above is not None else place
    level = Level(record.take(parent), own, above if above is not None else pa.nulls(len(child), S), child)
    there = pc.is_valid(child)
    return Level(*(x.filter(there) for x in (level.record, level.path, level.parent, level.objects)))


def levels(payloads: list[str | None], keys: pa.Array, shape: Shape) -> dict[str, Level]:
    """The objects of a batch of payloads by kind, for the wanted kinds and those above them; `keys` are the records' keys."""
    records = shape.records(payloads)
    out: dict[str, Level] = {}
    for kind in KINDS:
        if kind in TOP and kind in shape.top:
            out[kind] = _down(_field(records, kind), keys, None)
        elif kind in CHILDREN and shape._needed(kind):
            above, field = CHILDREN[kind]
            out[kind] = _down(_field(out[above].objects, field), out[above].record, out[above].path)
    return out


#: Columns of the flat table of each kind: name -> field of the object, dotted where it lies in a struct.
COLUMNS = {
    "entity": {"id": "id", "name": "name", "entity_type": "type", "source_file": "sourceFile"},
    "method": {"name": "name", "return_type": "returnType"},
    "param": {"name": "name", "param_type": "type"},
    "outgoing": {"rel_type": "relType", "target_id": "targetId"},
    "package_node": {"id": "id", "name": "name", "node_type": "type", "file_count": "fileCount", "structs": "stats.structs", "interfaces": "stats.interfaces", "functions": "stats.functions"},
    "package_edge": {"source": "source", "target": "target", "strength": "strength"},
    "capability_node": {"id": "id", "name": "name", "package": "package", "node_type": "type", "exported": "exported"},
    "goroutine_node": {"id": "id", "name": "name", "package": "package", "node_type": "type", "file": "location.file", "line": "location.line"},
    "call_chain": {"id": "id", "entry_point": "entryPoint"},
    "call_edge": {"source": "from", "target": "to", "call_type": "type", "confidence": "confidence"},
}
SQL_TYPES = {"fileCount": "bigint", "stats.structs": "bigint", "stats.interfaces": "bigint", "stats.functions": "bigint", "strength": "bigint", "exported": "boolean", "location.line": "bigint", "confidence": "double"}


def _field(objects: pa.StructArray, path: str) -> pa.Array:
    return pc.struct_field(objects, path.split("."))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts small enough for their decoded payloads to lie in memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def found(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """(raw_id, kind, path): one row per object in the lists of the payloads.

    Rows repeat if records are repeated; a null key stays null. Missing,
    broken and non-object payloads give no rows.
    """

    shape = Shape(NO_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = levels(b.column(1).to_pylist(), b.column(0), shape)
            kinds = pa.concat_arrays([pa.repeat(pa.scalar(k, S), len(lv.path)) for k, lv in found.items()])
            if len(kinds):
                records, paths = (pa.concat_arrays([getattr(lv, x) for lv in found.values()]) for x in ("record", "path"))
                yield pa.RecordBatch.from_arrays([records, kinds, paths], ["raw_id", "kind", "path"])

    return df.select(key, payload).mapInArrow(run, f"raw_id {dict(df.dtypes)[key]}, kind string, path string")


def flat(df: DataFrame, kind: str, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """The flat table of one kind: raw_id, path, parent_path (null at the outermost list) and the object's fields.

    `raw_id` with `parent_path` is the key of the parent in the flat table of
    its kind. Absent, null and empty lists give no rows; repeated records give
    repeated rows.
    """
    cols = COLUMNS[kind]
    shape = Shape({kind: tuple(dict.fromkeys(f.split(".")[0] for f in cols.values()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            lv = levels(b.column(1).to_pylist(), b.column(0), shape)[kind]
            if len(lv.path):
                yield pa.RecordBatch.from_arrays(
                    [lv.record, lv.path, lv.parent, *(_field(lv.objects, f) for f in cols.values())],
                    ["raw_id", "path", "parent_path", *cols],
                )

    fields = ", ".join(f"{c} {SQL_TYPES.get(f, 'string')}" for c, f in cols.items())
    return df.select(key, payload).mapInArrow(run, f"raw_id {dict(df.dtypes)[key]}, path string, parent_path string, {fields}")


def targets(df: DataFrame, *keep: str, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """(raw_id, target_id, kept columns): the references of all outgoing objects, kept columns taken along by record."""
    shape = Shape({"outgoing": ("targetId",)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            lv = levels(b.column(1).to_pylist(), pa.array(np.arange(b.num_rows)), shape)["outgoing"]
            if len(lv.path):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(lv.record), _field(lv.objects, "targetId"), *(b.column(i + 2).take(lv.record) for i in range(len(keep)))],
                    ["raw_id", "target_id", *keep],
                )

    types = dict(df.dtypes)
    return df.select(key, payload, *keep).mapInArrow(run, ", ".join([f"raw_id {types[key]}", "target_id string", *(f"{k} {types[k]}" for k in keep)]))
