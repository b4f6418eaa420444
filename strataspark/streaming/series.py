"""Snapshots and results as streams: windowed counts, late rows, and trends with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Change from which a trend rises or falls (fixed value).
STEP = 0.002


def snapshot_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 50) -> DataFrame:
    """Snapshots from Parquet files as they arrive; `taken_at` as a time that watermarks can use."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("taken_at", F.col("taken_at").cast("timestamp"))


def windowed(stream: DataFrame, at: str, late: str = "2 days", width: str = "7 days", slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per window and keys; rows later than `late` are dropped, rows without a time count nowhere."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: rows no further apart than `gap`."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")


def trends(stream: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, value, trend): every new value beside the one before it of its key; rows older than the newest seen are left out."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).dropna(subset=[at, value]).sort_values([at, value])
        for t, v in zip(rows[at], rows[value]):
            if last_at is not None and t.value // 1000 <= last_at:
                continue
            trend = "unknown" if last is None else "rising" if v - last > STEP else "falling" if v - last < -STEP else "stable"
            out.append((k[0], t, float(v), trend))
            last_at, last = t.value // 1000, float(v)
        if last_at is not None:
            state.update((last_at, last))
        yield pd.DataFrame(out, columns=[key, at, value, "trend"])

    return stream.select(key, at, value).where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(
        step, f"`{key}` string, `{at}` timestamp, `{value}` double, trend string", "last_at bigint, last double", "append", GroupStateTimeout.NoTimeout
    )
