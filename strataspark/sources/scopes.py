"""Scopes, and stores of snapshots and series as Parquet and JSON lines."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Snapshots of structural health that a series keeps (fixed value).
KEEP = 500


def resolve(scopes: list[dict], wanted: str | None, global_key: str | None = None) -> str:
    """The key of a scope: `global`, an exact key, the only label that contains the text, the sole scope, or the global one.

    Scopes are a handful of manifest entries {key, label, kind, entities}.
    """
    keys = [s["key"] for s in scopes]
    if wanted == "global":
        if global_key is None:
            raise KeyError("there is no global scope")
        return global_key
    if wanted is not None:
        if wanted in keys:
            return wanted
        hits = [s["key"] for s in scopes if wanted.lower() in (s.get("label") or "").lower()]
        if len(hits) == 1:
            return hits[0]
        raise KeyError(f"{'no' if not hits else 'more than one'} scope matches {wanted!r}: {sorted(hits or keys)}")
    if len(keys) == 1:
        return keys[0]
    if global_key is not None:
        return global_key
    raise KeyError(f"several scopes, and none is named: {sorted(keys)}")


def global_scope(scopes: DataFrame) -> DataFrame:
    """The scope that stands for all: parsed ones first, then most entities, then the smallest key. One row, none of an empty table."""
    return scopes.orderBy(F.desc(F.coalesce(F.col("kind") == "parsed", F.lit(False))), F.desc_nulls_last("entities"), "key").limit(1)


def scope_hash(sources: list[str], language: str = "typescript") -> str:
    """Eight characters that name a scope by its language and sources, in whatever order and with whichever slashes these are given."""
    told = "|".join(sorted(s.replace("\\", "/") for s in sources))
    return hashlib.sha256(f"{language}::{told}".encode()).hexdigest()[:8]


def merge_manifest(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Entries of both, those of `new` where a key is in both."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def save_scope(df: DataFrame, path: str) -> None:
    """Write a scope's table; scopes are partitions and only those in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope_key").parquet(path)


def append_series(df: DataFrame, path: str) -> None:
    """Append rows of a series as JSON lines."""
    df.write.mode("append").json(path)


def read_series(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A series of JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def prune(series: DataFrame, keys: list[str], at: str, keep: int = KEEP) -> DataFrame:
    """The newest `keep` rows of every group; rows without a time are the oldest, of equal times the hash of the whole row decides."""
    ends = [F.desc_nulls_last(at), F.xxhash64(*series.columns), *(F.col(c) for c, t in series.dtypes if not t.startswith("map"))]
    if not keys:
        return series.orderBy(*ends).limit(keep)
    order = Window.partitionBy(*keys).orderBy(*ends)
    return series.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= keep).drop("__r")


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table that `df` may have been read from.

    The new one is written beside it; the old one is moved aside, the new one
    into place, and only then the old one is deleted. At any moment at least
    one of both is whole: after a crash `recover_table` puts it back.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    recover_table(spark, path)
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}{_OLD}"
    df.write.parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)) and not fs.rename(hadoop(path), hadoop(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(hadoop(new), hadoop(path)):
        fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(hadoop(old), True)


_OLD = ".replaced"


def recover_table(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement that was cut short: the old table returns if no new one is in its place, else it goes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop(path.rstrip("/") + _OLD)
    if fs.exists(old):
        if fs.exists(hadoop(path)):
            fs.delete(old, True)
        else:
            fs.rename(old, hadoop(path))


def content_key(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with `content_hash`, to see which have changed since they were last worked on."""
    return df.withColumn("content_hash", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256))


def git_log_texts(spark: SparkSession, path: str) -> DataFrame:
    """Raw log texts, a row per file."""
    return spark.read.text(path, wholetext=True)


def source_files(spark: SparkSession, path: str, glob: str = "*", exclude: str | None = None) -> DataFrame:
    """(file, text): the files below a folder whose name matches a glob, and whose path does not match the pattern `exclude`."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return files if exclude is None else files.where(~F.col("file").rlike(exclude))
