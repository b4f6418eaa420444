"""Percentiles by relative-rank compactors.

A sketch keeps levels of values; a value on level h stands for 2**h values. A
full level is sorted; the part next to the protected tail stays as it is, of
the rest every other value moves one level up. So ranks near the protected end
are exact or nearly so and the error grows with the distance from it: the rank
error is a fraction of the rank counted from that end. Two such halves, one
for each end, make a sketch whose extreme percentiles are sharp on both sides.

How much of a level is compacted follows the published schedule: the half next
to the protected end never is; of the other half, made of sections of k values,
the c-th compaction takes as many sections as c has trailing ones, and one. So
the sections are taken half, a quarter, ... as often the nearer they lie to the
protected end. Whether the odd or the even values move up is drawn at random,
and every second draw of a level is the opposite of the one before, so that
errors cancel. When sketches are merged their levels are joined, the numbers of
their compactions are united bitwise, and what is too full is compacted.

The draws come from a seed that is the hash of the partition's number, the
group and the values, mixed when sketches are merged: parts that hold the same
values draw differently, and a task that is run again gives the same sketch.

Error limit, with k = 32: the rank of a reported value is off by less than 5 %
of its distance in rank from the nearer end, plus one. The limit is a
probable one, as for every sketch of this kind: the standard deviation is below
1 % (tests measure it over parts that are strided over the values, sorted and
random), so 5 % is left with a chance of less than one in a million.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a section; the error falls as it grows.
K = 32
#: Rank error as a share of the distance from the nearer end.
LIMIT = 0.05
#: Rows whose groups are told apart together, and values from which a group's sketch is kept for the task's next rows.
BUFFER, LARGE = 200_000, 1000
#: Sketches that a task holds, and values of one group's sketches before they are joined.
HELD, JOINED = 2000, 200_000
#: Parts in which the sketches of a group are merged first, so that no task reads all of them.
SALTS = 64

_MASK = (1 << 64) - 1


def _mix(*numbers: int) -> int:
    """One 64-bit number of several."""
    out = 0
    for n in numbers:
        out = (out ^ n) * 0x9E3779B97F4A7C15 & _MASK
        out ^= out >> 29
        out = out * 0xBF58476D1CE4E5B9 & _MASK
        out ^= out >> 32
    return out


class Compactor:
    """One half: `low` protects the small values, otherwise the large ones."""

    def __init__(self, low: bool, k: int = K, seed: int = 0):
        self.low, self.k, self.seed, self.n = low, k, seed, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        #: Of each level: compactions so far, and the last draw.
        self.times, self.coins = [0], [0]

    def _sections(self) -> int:
        return max(3, math.ceil(math.log2(max(2.0, self.n / self.k))))

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compact()

    def merge(self, *others: Compactor) -> None:
        deepest = max(others, key=lambda o: len(o.levels))
        while len(self.levels) < len(deepest.levels):
            self._deepen()
        for h in range(len(deepest.levels)):
            self.levels[h] = np.concatenate([self.levels[h], *(o.levels[h] for o in others if h < len(o.levels))])
        for o in others:
            self.n += o.n
            self.seed = _mix(self.seed, o.seed)
            for h, c in enumerate(o.times):
                self.times[h] |= c
        self._compact()

    def _deepen(self) -> None:
        self.levels.append(np.empty(0))
        self.times.append(0)
        self.coins.append(0)

    def _compact(self) -> None:
        sections = self._sections()
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            if len(level) > 2 * self.k * sections:
                level = np.sort(level)
                if not self.low:
                    level = level[::-1]
                c = self.times[h]
                ones = (~c & (c + 1)).bit_length() - 1
                protected = self.k * (2 * sections - min(ones + 1, sections))
                extra = (len(level) - protected) // 2 * 2
                kept, rest = level[: len(level) - extra], level[len(level) - extra :]
                coin = 1 - self.coins[h] if c & 1 else _mix(self.seed, h, c, self.n) & 1
                if h + 1 == len(self.levels):
                    self._deepen()
                self.times[h], self.coins[h] = c + 1, coin
                self.levels[h] = kept
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], rest[coin::2]])
            h += 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], weights[order]


class Sketch:
    """Both halves of the values of one group."""

    def __init__(self, k: int = K, seed: int = 0):
        self.low, self.high = Compactor(True, k, _mix(seed, 1)), Compactor(False, k, _mix(seed, 2))

    @property
    def n(self) -> int:
        return self.low.n

    def add(self, values: np.ndarray) -> None:
        self.low.add(values)
        self.high.add(values)

    def merge(self, *others: Sketch) -> None:
        if others:
            self.low.merge(*(o.low for o in others))
            self.high.merge(*(o.high for o in others))

    def quantile(self, q: float) -> float:
        """The value of which a share q of all values is not larger, by the half whose end is nearer."""
        if not self.n:
            return math.nan
        half = self.low if q <= 0.5 else self.high
        values, weights = half.weighted()
        rank = max(1, math.ceil(q * self.n))
        if half is self.low:
            at = np.searchsorted(np.cumsum(weights), rank)
        else:
            above = np.cumsum(weights[::-1])[::-1]  # values not smaller than this one
            at = len(values) - 1 - np.searchsorted(above[::-1], self.n - rank + 1)
        return float(values[min(max(at, 0), len(values) - 1)])

    def pack(self) -> bytes:
        """The sketch as bytes; as long as nothing was compacted both halves hold the same values and one is written."""
        whole = len(self.low.levels) == len(self.high.levels) == 1
        out = [struct.pack("<IB", self.low.k, whole)]
        for half in (self.low, self.high):
            out.append(struct.pack("<QQB", half.n, half.seed, len(half.levels)))
            for v, times, coin in zip(half.levels, half.times, half.coins):
                out.append(struct.pack("<QBI", times, coin, len(v)))
                if not (whole and half is self.high):
                    out.append(v.astype("<f8").tobytes())
        return b"".join(out)

    @classmethod
    def unpack(cls, data: bytes) -> Sketch:
        k, whole = struct.unpack_from("<IB", data)
        s, at = cls(k), 5
        for half in (s.low, s.high):
            half.n, half.seed, depth = struct.unpack_from("<QQB", data, at)
            at += 17
            half.levels, half.times, half.coins = [], [], []
            for _ in range(depth):
                times, coin, n = struct.unpack_from("<QBI", data, at)
                at += 13
                if whole and half is s.high:
                    half.levels.append(s.low.levels[0])
                else:
                    half.levels.append(np.frombuffer(data, "<f8", n, at))
                    at += 8 * n
                half.times.append(times)
                half.coins.append(coin)
        return s


def _seed(part: int, key: tuple, values: np.ndarray) -> int:
    told = hashlib.blake2b(repr((part, key)).encode("utf-8", "surrogatepass"), digest_size=8)
    told.update(values.tobytes())
    return int.from_bytes(told.digest(), "little")


def sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, sketch): one mergeable sketch per group of the rows' keys.

    Every partition folds its own rows first, so that a group with a third of
    all rows sends a few sketches of a partition, not its rows. Null values and
    those that are no number are left out; an empty table gives no rows. A null
    key is a group of its own.
    """
    return merge_sketches(partial_sketches(df, keys, value, k), keys)


def partial_sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """The same before the sketches of a group's partitions are merged: one row or more per group."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "sketch binary"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: dict[tuple, Sketch] = {}

        def told_apart(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            codes = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            values = rows[value].to_numpy(float)[order]
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            small: list[tuple] = []
            names = rows[keys].iloc[order[starts]].itertuples(index=False, name=None)
            for key, v in zip(names, np.split(values, starts[1:])):
                key = tuple(None if _none(x) else x for x in key)
                if key in held:
                    held[key].add(v)
                    continue
                s = Sketch(k, _seed(part, key, v))
                s.add(v)
                if len(v) >= LARGE:
                    held[key] = s
                else:
                    small.append((key, s))
            if small:
                yield _frame(small, keys)

        waiting: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            waiting.append(b)
            n += len(b)
            if n >= BUFFER:
                yield from told_apart(pd.concat(waiting, ignore_index=True))
                waiting, n = [], 0
                if len(held) > HELD:
                    yield _frame(list(held.items()), keys)
                    held.clear()
        if n:
            yield from told_apart(pd.concat(waiting, ignore_index=True))
        if held:
            yield _frame(list(held.items()), keys)

    rows = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.mapInPandas(fold, schema)


def _frame(held: list[tuple[tuple, Sketch]], keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([list(key) for key, _ in held], columns=keys, dtype=object)
    return out.assign(sketch=[s.pack() for _, s in held])


def _none(x: object) -> bool:
    return x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x)


def merge_sketches(df: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """(keys, sketch): the sketches of partitions, days or any other parts, joined per group.

    They are merged in two steps: `salts` parts of a group's sketches each by
    itself, then the one sketch of each part. So a group of 100,000 partitions
    is spread over `salts` tasks, and the last one reads `salts` sketches.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "sketch binary"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of one group follow each other; of a group its running sketch and a bounded number of values are held
        current, acc, waiting, size = None, None, [], 0
        done: list[tuple[tuple, Sketch]] = []
        for b in batches:
            for *key, data in b[[*keys, "sketch"]].itertuples(index=False, name=None):
                key = tuple(None if _none(x) else x for x in key)
                if acc is None or key != current:
                    if acc is not None:
                        acc.merge(*waiting)
                        done.append((current, acc))
                        waiting, size = [], 0
                    if len(done) >= HELD:
                        yield _frame(done, keys)
                        done = []
                    current, acc = key, Sketch.unpack(data)
                else:
                    waiting.append(Sketch.unpack(data))
                    size += len(data) // 8
                    if size >= JOINED:
                        acc.merge(*waiting)
                        waiting, size = [], 0
        if acc is not None:
            acc.merge(*waiting)
            done.append((current, acc))
        if done:
            yield _frame(done, keys)

    rows = df.select(*keys, "sketch", F.xxhash64("sketch").alias("__h"))
    salt = F.pmod("__h", F.lit(salts))
    ordered = rows.withColumn("__salt", salt).repartition(*keys, "__salt").sortWithinPartitions(*keys, "__salt", "__h")
    # rows of a group and salt follow each other here, and the groups of a salt do not matter: a task joins all its rows of a group that do
    some = ordered.drop("__salt", "__h").mapInPandas(join, schema)
    last = some.withColumn("__h", F.xxhash64("sketch")).repartition(*keys).sortWithinPartitions(*keys, "__h").drop("__h")
    return last.mapInPandas(join, schema)


def estimates(df: DataFrame, quantiles: list[float], keys: list[str]) -> DataFrame:
    """(keys, n, one column pXX per quantile) of a frame of sketches."""
    types = dict(df.dtypes)
    names = [column(q) for q in quantiles]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "n bigint", *(f"`{c}` double" for c in names)])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [Sketch.unpack(x) for x in b["sketch"]]
            cols = {c: [s.quantile(q) for s in held] for c, q in zip(names, quantiles)}
            yield b[keys].assign(n=[s.n for s in held], **cols)

    return df.select(*keys, "sketch").mapInPandas(read, schema)


def column(q: float) -> str:
    """The column of a quantile: p50, p99, p99_9."""
    return "p" + f"{100 * q:.4f}".rstrip("0").rstrip(".").replace(".", "_")


def valid_scores(df: DataFrame, plain) -> DataFrame:
    """(result_id, model, format_name, run_date, mean_score): every result once, only those that count.

    Rows without a model or format (null or blank), and scores that are null,
    not a number or outside 0..1, are left out. Of several rows of a result_id
    the first by arrival counts; rows without an id count each for itself.
    """
    score: Column = F.col("mean_score").cast("double")
    ok = (F.col("model") != "") & (F.col("format_name") != "") & ~F.isnan("mean_score") & F.col("mean_score").between(0, 1)
    rows = df.select(
        "result_id", plain("model").alias("model"), plain("format_name").alias("format_name"), "run_date",
        score.alias("mean_score"), "ingested_at",
    ).where(ok)
    value = F.struct(F.col("ingested_at"), "run_date", "model", "format_name", "mean_score")
    once = (
        rows.where(F.col("result_id").isNotNull())
        .groupBy("result_id")
        .agg(F.min(value).alias("v"))
        .select("result_id", "v.model", "v.format_name", "v.run_date", "v.mean_score")
    )
    return once.unionByName(rows.where(F.col("result_id").isNull()).drop("ingested_at"))
