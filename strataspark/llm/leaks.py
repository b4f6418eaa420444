"""Passages of held-out items inside a corpus, also when re-parameterised.

Words are replaced by typed placeholders (numbers, units, names of the item's
kind of code), which leaves the template of a text. Windows of a document and
of the items with equal templates are joined by hash. Of such a pair the slots
are compared: equal fillings are a leak of the passage; fillings that map one
to one onto each other throughout the window show the same question with other
parameters.

The index holds the items only. Where they are few, it goes to the workers
whole and documents are not shuffled. Of more items the windows become a table:
one pass over the documents keeps the windows that a filter of bounded size
does not rule out (a filter of bits, which rules out nothing that is there), as
128-bit hashes of their words and slots, and these meet the table by ordinary
joins. So the corpus is read once however many items there are, and items never
gather in the driver.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.plans.storage import cut

#: Words of a window, in a row in both texts (fixed by the task).
WINDOW = 12
#: Items up to which the index is broadcast. A passage of 1,000 words takes some 100 kB of it.
ITEMS_BROADCAST = 2000
#: Bytes of the filter of more items' windows, and bytes of a piece of it that is put together by itself. Ten bits a window let 1 % pass in vain.
FILTER, PIECE = 1 << 26, 1 << 20
#: Documents whose words are hashed together.
DOCUMENTS = 256
#: Units of measure (fixed values).
UNITS = frozenset("ms s sec min h kb mb gb tb b px pt pct percent bytes lines files seconds minutes hours days steps".split())
NUMBER, UNIT, NAME = "\x00number", "\x00unit", "\x00name"

_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits after compatibility normalization and lower-casing."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower())


def spelled(text: str | None) -> list[str]:
    """The same words before lower-casing."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text)
    text = unicodedata.normalize("NFKC", text).replace("\u0130", "i\u0307")  # the only letter whose lower case is longer
    return [text[m.start() : m.end()] for m in _WORD.finditer(text.lower())]


def camel(word: str) -> list[str]:
    """The parts of a name in camel case, lower-cased and without the digits that end it; none for any other word."""
    bare = _DIGITS.sub("", word)
    if bare in (bare.lower(), bare.upper(), bare.capitalize()) or not all(c.isupper() or c.islower() for c in bare):
        return []
    cuts = [i for i in range(1, len(bare)) if bare[i].isupper() and (bare[i - 1].islower() or len(bare) > i + 2 and bare[i + 1 : i + 3].islower())]
    return [bare[a:b].lower() for a, b in zip([0, *cuts], [*cuts, len(bare)])] if cuts else []


def name_parts(passages: list[str | None]) -> tuple[frozenset, frozenset, frozenset]:
    """First, middle and last parts of the names in camel case that the passages hold, lower-cased.

    A name's case is often lost in a copy, so a word counts as a name if it is
    put together from such parts, whatever its case.
    """
    first, middle, last = set(), set(), set()
    for p in passages:
        for w in spelled(p):
            parts = camel(w)
            if parts:
                first.add(parts[0])
                middle.update(parts[1:-1])
                last.add(parts[-1])
    return frozenset(first), frozenset(middle), frozenset(last)


class Templates:
    """Words as numbers: one for the word itself, one for its placeholder."""

    def __init__(self, parts: tuple[frozenset, frozenset, frozenset]):
        self.first, self.middle, self.last = parts
        self.longest = [max(map(len, x), default=0) for x in parts]
        self.known: dict[str, tuple[int, int]] = {}
        self.types: dict[str, str] = {}
        self.cased: dict[str, bool] = {}

    def composed(self, bare: str) -> bool:
        """Whether a word is put together from a first, any number of middle and a last part of the items' names."""
        first, middle, last = self.longest  # no longer piece of a word is a part
        todo = [n for n in range(1, min(len(bare), first + 1)) if bare[:n] in self.first]
        seen = set(todo)
        while todo:
            n = todo.pop()
            if len(bare) - n <= last and bare[n:] in self.last:
                return True
            more = {m for m in range(n + 1, min(len(bare), n + middle + 1)) if bare[n:m] in self.middle} - seen
            seen |= more
            todo += more
        return False

    def placeholder(self, word: str) -> str:
        """The typed placeholder of a word, or the word itself. It depends on nothing but the lower-cased word."""
        out = self.types.get(word)
        if out is None:
            if len(self.types) > 500_000:
                self.types.clear()
            if word in UNITS:
                out = UNIT
            elif self.composed(_DIGITS.sub("", word)):
                out = NAME
            else:
                out = NUMBER if any(c.isdigit() for c in word) else word
            self.types[word] = out
        return out

    def named(self, word: str, low: str) -> bool:
        """Whether only its spelling tells that a word is a name: its parts are in no item."""
        out = self.cased.get(word)
        if out is None:
            if len(self.cased) > 500_000:
                self.cased.clear()
            out = self.cased[word] = bool(camel(word)) and self.placeholder(low) not in (NAME, UNIT)
        return out

    def numbers(self, ws: list[str]) -> list[tuple[int, int]]:
        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for w in ws:
            pair = known.get(w)
            if pair is None:
                pair = known[w] = (_hash(w), _hash(self.placeholder(w)))
            out.append(pair)
        return out


def _hash(word: str) -> int:
    """64 bits of a word, the same in every process."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 29


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n numbers."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    return _combine(h[i : len(h) - n + 1 + i] for i in range(n))


def _combine(columns: Iterable[np.ndarray]) -> np.ndarray:
    """The hash of each row of numbers."""
    out = np.uint64(0)
    for c in columns:
        out = out * _BASE + c
    return out ^ (out >> np.uint64(31))


def _matches(h: np.ndarray, own: np.ndarray | None, both: np.ndarray | None, n: int, passes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, tuple[bool, ...]]]:
    """(first word, template, words that their spelling makes names) of the windows of n numbers whose template passes.

    Words in `own` are names by their spelling. Those in `both` are words of an
    item besides, so a window with k of them has 2^k templates.
    """
    if own is None or not own.any():
        t = _windows(h, n)
        yield from ((at, int(t[at]), (False,) * n) for at in np.flatnonzero(passes(t)).tolist())
        return
    name, fixed = np.uint64(_hash(NAME)), own & ~both
    h = np.where(fixed, name, h)
    t = _windows(h, n)
    for at in np.flatnonzero(passes(t)).tolist():
        yield at, int(t[at]), tuple(fixed[at : at + n].tolist())
    if len(t) and both.any():
        sums = np.concatenate([[0], np.cumsum(both)])
        for at in np.flatnonzero(sums[n:] > sums[:-n]).tolist():
            where = np.flatnonzero(both[at : at + n])
            picks = np.arange(1, 1 << len(where))[:, None] >> np.arange(len(where)) & 1 == 1
            rows = np.repeat(h[None, at : at + n], len(picks), 0)
            rows[:, where] = np.where(picks, name, rows[:, where])
            more = _combine(rows.T)
            for j in np.flatnonzero(passes(more)).tolist():
                names = fixed[at : at + n].copy()
                names[where] = picks[j]
                yield at, int(more[j]), tuple(names.tolist())


def binding(ws: tuple[str, ...], holes: tuple[bool, ...]) -> tuple[int, ...]:
    """For each slot of a window the slot where its filling first occurs: equal for two windows if and only if their fillings map one to one."""
    seen: dict[str, int] = {}
    return tuple(seen.setdefault(w, len(seen)) for w, hole in zip(ws, holes) if hole)


class Index:
    """The windows of a block of items: template -> the windows as they are, and their bindings."""

    def __init__(self, items: list[tuple[int, str | None]], parts: tuple[frozenset, frozenset, frozenset], n: int = WINDOW):
        self.templates, self.n = Templates(parts), n
        self.exact: dict[int, dict[tuple[str, ...], set[int]]] = {}
        self.bound: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.words: set[str] = set()
        for item, passage in items:
            ws = words(passage)
            if len(ws) < n:
                continue
            self.words.update(ws)
            nums = np.array(self.templates.numbers(ws), np.uint64)
            for at, t in enumerate(_windows(nums[:, 1], n).tolist()):
                w = tuple(ws[at : at + n])
                self.exact.setdefault(t, {}).setdefault(w, set()).add(item)
                self.bound.setdefault(t, {}).setdefault(binding(w, self.holes(w)), set()).add(item)
        self.sorted = np.array(sorted(self.exact), np.uint64)

    def holes(self, ws: tuple[str, ...]) -> tuple[bool, ...]:
        return tuple(self.templates.placeholder(w)[0] == "\x00" for w in ws)

    def candidates(self, texts: list[str | None]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(text, template, window) wherever a window's template is one of the items'."""
        return (x[:3] for x in self.placed(texts))

    def placed(self, texts: list[str | None], spelling: bool = False) -> Iterator[tuple[int, int, tuple[str, ...], int, tuple[bool, ...]]]:
        """The same with the window's first word, counted in its text, and the words that are names by their spelling, if that counts."""
        lists = [words(t) for t in texts]
        flat = [w for ws in lists for w in ws]
        if len(flat) < self.n or not len(self.sorted):
            return
        own = both = None
        if spelling:
            own = np.fromiter((x != w and self.templates.named(x, w) for x, w in zip((x for t in texts for x in spelled(t)), flat, strict=True)), bool, len(flat))
            both = own.copy()
            for at in np.flatnonzero(own).tolist():
                both[at] = flat[at] in self.words
        nums = np.array(self.templates.numbers(flat), np.uint64)
        ends = np.cumsum([len(ws) for ws in lists])
        for h, t, names in _matches(nums[:, 1], own, both, self.n, self.passes):
            d = int(np.searchsorted(ends, h, side="right"))
            if h + self.n <= ends[d]:  # windows across two texts are none
                yield d, t, tuple(flat[h : h + self.n]), h - int(ends[d]) + len(lists[d]), names

    def passes(self, t: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.sorted, t)
        at[at == len(self.sorted)] = 0
        return self.sorted[at] == t

    def follows(self, t: int, w: tuple[str, ...], names: tuple[bool, ...]) -> tuple[bool, int]:
        """Whether a window has an item's own words, and how many other items have other fillings of the same slots."""
        same = self.exact[t].get(w, ())
        holes = tuple(a or b for a, b in zip(self.holes(w), names))
        return bool(same), len(self.bound[t].get(binding(w, holes), ())) - len(same)


def _names(items: DataFrame, passage: str) -> tuple[frozenset, frozenset, frozenset]:
    """The parts of names of all items' passages; each part reaches the driver once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(w, place) for place, ws in enumerate(name_parts(b.column(0).to_pylist())) for w in ws]
            if parts:
                w, place = zip(*parts)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(place, pa.int32())], ["part", "place"])

    rows = items.select(passage).mapInArrow(run, "part string, place int").distinct().collect()
    return tuple(frozenset(r.part for r in rows if r.place == k) for k in range(3))


def _few(items: DataFrame, item: str, passage: str) -> list | None:
    """The items if they are few enough to be broadcast."""
    rows = items.select(item, passage).where(F.col(item).isNotNull()).limit(ITEMS_BROADCAST + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= ITEMS_BROADCAST else None


def _search(docs: DataFrame, rows: list, names: tuple, key: str, text: str, schema: str, row) -> DataFrame:
    """What `row` finds in every batch of documents with the index of few items."""
    shared = docs.sparkSession.sparkContext.broadcast((rows, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                b = batch.slice(at, DOCUMENTS)
                yield from row(index, b.column(0), b.column(1).to_pylist())

    return docs.select(key, text).mapInArrow(run, schema)


HASHES = ["__t", "__e1", "__e2", "__b1", "__b2"]


class Hasher:
    """Windows of texts as hashes: of the template, of the words (128 bits) and of the template with its binding (128 bits)."""

    def __init__(self, names: tuple[frozenset, frozenset, frozenset], bits: np.ndarray | None = None, spelling: bool = False):
        self.templates, self.bits, self.spelling = Templates(names), bits, spelling

    def passes(self, t: np.ndarray) -> np.ndarray:
        return np.ones(len(t), bool) if self.bits is None else _passes(self.bits, t)

    def windows(self, texts: list[str | None]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(text, place, hashes) of all windows that the filter lets pass."""
        for d, ws in enumerate(map(words, texts)):
            if len(ws) < WINDOW:
                continue
            nums = np.array(self.templates.numbers(ws), np.uint64)
            own = both = None
            if self.spelling:
                own = np.fromiter((x != w and self.templates.named(x, w) for x, w in zip(spelled(texts[d]), ws, strict=True)), bool, len(ws))
                both = own & self.passes(nums[:, 0])
            for at, t, names in _matches(nums[:, 1], own, both, WINDOW, self.passes):
                w = tuple(ws[at : at + WINDOW])
                types = [NAME if n else self.templates.placeholder(x) for x, n in zip(w, names)]
                holes = tuple(x[0] == "\x00" for x in types)
                shape = " ".join("\x00" if h else x for x, h in zip(w, holes)) + repr(binding(w, holes)) + repr([x for x, h in zip(types, holes) if h])
                yield d, at, (t - (t >> 63 << 64), *_two(" ".join(w)), *_two(shape))


def _two(text: str) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())


def _places(t: np.ndarray) -> list[np.ndarray]:
    """Three bits of the filter for every template."""
    t = t.astype(np.uint64)
    return [((t >> np.uint64(s)) * _BASE >> np.uint64(16)) % np.uint64(FILTER * 8) for s in (0, 13, 27)]


def _passes(bits: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.ones(len(t), bool)
    for at in _places(t):
        out &= bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1
    return out


def _filter(index: DataFrame) -> np.ndarray:
    """The bits of all templates of an index: set in pieces of bytes that are united on the cluster, FILTER bytes in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            for at in _places(b.column(0).to_numpy().view(np.uint64)):
                byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
                for p in np.unique(byte // PIECE).tolist():
                    mine = byte // PIECE == p
                    np.bitwise_or.at(pieces.setdefault(p, np.zeros(PIECE, np.uint8)), byte[mine] % PIECE, bit[mine])
        for p, x in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint8)
                held[p] = held[p] | x if p in held else x
        for p, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "bits"])

    schema = "piece int, bits binary"
    out = np.zeros(FILTER, np.uint8)
    for r in index.select("__t").distinct().mapInArrow(run, schema).repartition("piece").mapInArrow(unite, schema).toLocalIterator():
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.bits, np.uint8)
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the words of texts."""
    for b in batches:
        found = {w for t in b.column(0).to_pylist() for w in words(t)}
        yield pa.RecordBatch.from_arrays([pa.array(np.array([_hash(w) for w in found], np.uint64).view(np.int64))], ["__t"])


def _tables(docs: DataFrame, items: DataFrame, names: tuple, key: str, text: str, item: str, passage: str, spelling: bool = False) -> tuple[DataFrame, DataFrame]:
    """(windows of documents that may be an item's, windows of items), as hashes, with (__doc, __copy, __place) and (__item)."""
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(names)
    hashed = ", ".join(f"{h} bigint" for h in HASHES)

    def columns(found: list) -> list[pa.Array]:
        return [pa.array(x, pa.int64()) for x in zip(*(h for _, _, h in found))]

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shared.value)
        for b in batches:
            found = list(hasher.windows(b.column(1).to_pylist()))
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([d for d, _, _ in found])), *columns(found)], ["__item", *HASHES])

    index = cut(items.select(item, passage).where(F.col(item).isNotNull()).mapInArrow(of_items, f"__item {item_kind}, {hashed}").distinct())
    templates = index.select("__t")
    if spelling:  # the filter tells the words of items, too
        templates = templates.union(items.where(F.col(item).isNotNull()).select(passage).mapInArrow(_words, "__t bigint"))
    bits = sc.broadcast(_filter(templates))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shared.value, bits.value, spelling)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                b = batch.slice(at, DOCUMENTS)
                texts = b.column(1).to_pylist()
                found = list(hasher.windows(texts))
                if found:
                    copies = {d: hashlib.blake2b(texts[d].encode("utf-8", "surrogatepass"), digest_size=16).digest() for d in {d for d, _, _ in found}}
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([d for d, _, _ in found])), pa.array([copies[d] for d, _, _ in found], pa.binary()), pa.array([p for _, p, _ in found], pa.int64()), *columns(found)],
                        ["__doc", "__copy", "__place", *HASHES],
                    )

    return docs.select(key, text).mapInArrow(of_documents, f"__doc {kind}, __copy binary, __place bigint, {hashed}"), index


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id): the document shares WINDOW consecutive words with the passage. One row per pair.

    Null, empty and shorter texts and passages share nothing; texts are read
    whole; repeated documents with the same key give one row.
    """
    types = dict(docs.dtypes)[key], dict(items.dtypes)[item]

    def row(index: Index, keys: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        found = {(d, i) for d, t, w in index.candidates(texts) for i in index.exact[t].get(w, ())}
        if found:
            d, i = zip(*sorted(found))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(d, pa.int64())), pa.array(i)], [key, item])

    names, few = _names(items, passage), _few(items, item, passage)
    if few is not None:
        return _search(docs, few, names, key, text, f"`{key}` {types[0]}, `{item}` {types[1]}", row).distinct()
    windows, index = _tables(docs, items, names, key, text, item, passage)
    same = ["__t", "__e1", "__e2"]
    return windows.select("__doc", *same).distinct().join(index.select("__item", *same), same).select(F.col("__doc").alias(key), F.col("__item").alias(item)).distinct()


def reparameterised(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, exact_windows, template_windows, items): per document that follows the template of an item with consistent slots.

    exact_windows have an item's own words, template_windows other fillings
    that map one to one onto an item's; a window that has one item's own words
    and refills another's slots is both. `items` is the largest number of items
    whose fillings one window replaces. Names are told by the items' names and
    by their own spelling. Different texts with the same key are counted
    together, repeated ones once. Documents without any give no row.
    """
    kind = dict(docs.dtypes)[key]
    counts = ["exact_windows", "template_windows", "items"]

    def row(index: Index, keys: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        exact, other, most = {}, {}, {}
        for d, t, w, place, names in index.placed(texts, spelling=True):
            own, n = index.follows(t, w, names)
            if own:
                exact.setdefault(d, set()).add(place)
            if n:
                other.setdefault(d, set()).add(place)
                most[d] = max(n, most.get(d, 0))
        hits = sorted(exact.keys() | other.keys())
        if hits:
            copies = [hashlib.blake2b(texts[d].encode("utf-8", "surrogatepass"), digest_size=16).digest() for d in hits]
            figures = [[len(exact.get(d, ())) for d in hits], [len(other.get(d, ())) for d in hits], [most.get(d, 0) for d in hits]]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(hits, pa.int64())), pa.array(copies, pa.binary()), *(pa.array(x, pa.int64()) for x in figures)], ["__doc", "__copy", *counts])

    names, few = _names(items, passage), _few(items, item, passage)
    if few is not None:
        counted = _search(docs, few, names, key, text, f"__doc {kind}, __copy binary, " + ", ".join(f"{c} bigint" for c in counts), row).distinct()
    else:
        # a window's words or slots are in the table once, so a template that is common everywhere multiplies nothing
        found, index = _tables(docs, items, names, key, text, item, passage, spelling=True)
        exact = index.groupBy("__t", "__e1", "__e2").agg(F.countDistinct("__item").alias("e"))
        bound = index.groupBy("__t", "__b1", "__b2").agg(F.countDistinct("__item").alias("n"))
        windows = found.join(exact, ["__t", "__e1", "__e2"], "left").join(bound, ["__t", "__b1", "__b2"], "left").where(F.col("e").isNotNull() | F.col("n").isNotNull())
        windows = windows.groupBy("__doc", "__copy", "__place").agg(F.max("e").isNotNull().alias("e"), F.max(F.col("n") - F.coalesce("e", F.lit(0))).alias("n"))
        counted = windows.groupBy("__doc", "__copy").agg(F.count_if("e").alias(counts[0]), F.count_if(F.col("n") > 0).alias(counts[1]), F.max("n").alias(counts[2]))
    return counted.groupBy(F.col("__doc").alias(key)).agg(*(F.sum(c).alias(c) for c in counts[:2]), F.max(counts[2]).alias(counts[2]))
