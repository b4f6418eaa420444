"""Results kept between runs: tables with a manifest, indexes with validation, series of health, and declared semantics of a project.

A store is a folder of Parquet tables and a manifest that is written last, so a
store without one is not there. Manifests are a few lines and go through the
driver; tables do not.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strataspark.sources.scopes import KEEP, prune, recover_table, replace_table

#: Versions that are read (fixed values).
INDEX_VERSION, HISTORY_VERSION, HEALTH_VERSION = "1.0", "2", "1.0"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    replace_table(spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1), f"{path.rstrip('/')}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a store, None where there is none; one that is no JSON is an error."""
    at = f"{path.rstrip('/')}/manifest"
    recover_table(spark, at)
    if not _exists(spark, at):
        return None
    try:
        return json.loads(spark.read.parquet(at).first()[0])
    except (ValueError, TypeError, AnalysisException) as e:
        raise ValueError(f"cannot read the manifest of {path}: {e}") from e


def save_results(spark: SparkSession, path: str, manifest: dict, **tables: DataFrame) -> None:
    """Write tables and then the manifest of a store, each in place of the one before."""
    for name, df in tables.items():
        replace_table(df, f"{path.rstrip('/')}/{name}")
    write_manifest(spark, path, manifest | {"tables": sorted(tables)})


def load_results(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]] | None:
    """The manifest and the tables of a store, None where there is none. A table the manifest names but that is gone is an error."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        return None
    return manifest, {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in manifest.get("tables", [])}


def save_history(spark: SparkSession, path: str, files: DataFrame, packages: DataFrame, depth: int) -> None:
    save_results(spark, path, {"version": HISTORY_VERSION, "package_depth": depth}, files=files, packages=packages)


def load_history(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """Manifest, files and packages of a history store. None there is an error; one of the first version, or without a depth, is read with a depth of 1 and a warning."""
    found = load_results(spark, path)
    if found is None:
        raise FileNotFoundError(f"no history at {path}; analyze it first")
    manifest, tables = found
    if str(manifest.get("version")) == "1" or manifest.get("package_depth") is None:
        warnings.warn("the history was written without package depth; 1 is assumed", stacklevel=2)
        manifest = manifest | {"package_depth": 1}
    return manifest, tables["files"], tables["packages"]


def digest(df: DataFrame) -> str:
    """What identifies the rows of a table, whatever their order: their number and two sums of hashes, added up where they lie."""
    cols = [c for c, t in df.dtypes if not t.startswith("map")]
    wide = F.xxhash64(*cols).cast("decimal(38,0)"), F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(h), F.lit(0)) for h in wide)).first()
    return "-".join(str(x) for x in r)


def load_index(spark: SparkSession, path: str, source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index of a source, built again where it is missing, unreadable, of another version or of other content."""
    now = digest(source)
    try:
        found = load_results(spark, path)
        if found and found[0].get("version") == INDEX_VERSION and found[0].get("digest") == now:
            return found[1]["index"]
    except (ValueError, KeyError, AnalysisException):
        pass
    save_results(spark, path, {"version": INDEX_VERSION, "digest": now}, index=build(source))
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def load_health(spark: SparkSession, path: str) -> DataFrame | None:
    """The series of structural health, None where there is none or it is of another version."""
    found = load_results(spark, path)
    return found[1]["series"] if found and found[0].get("version") == HEALTH_VERSION else None


def append_health(spark: SparkSession, path: str, rows: DataFrame, at: str = "timestamp", keep: int = KEEP) -> DataFrame:
    """Add rows to the series and keep the newest; one of another version is begun anew. Ties of time are ended by the whole row."""
    old = load_health(spark, path)
    series = prune(rows if old is None else old.unionByName(rows, allowMissingColumns=True), [], at, keep)
    save_results(spark, path, {"version": HEALTH_VERSION}, series=series)
    return spark.read.parquet(f"{path.rstrip('/')}/series")


def save_smells(spark: SparkSession, path: str, smells: DataFrame, layer: str = "literal-dispersion") -> None:
    save_results(spark, path, {"layers": [layer]}, smells=smells.withColumn("layer", F.lit(layer)))


def load_smells(spark: SparkSession, path: str, type_name: str | None = None, value: str | None = None, least: int = 0) -> DataFrame | None:
    """Kept smells, of a type, a value and at least so many files, if asked for; None where none are kept."""
    found = load_results(spark, path)
    if found is None:
        return None
    s = found[1]["smells"]
    for column, wanted in (("type_name", type_name), ("value", value)):
        if wanted is not None:
            s = s.where(F.col(column) == wanted)
    return s.where(F.col("files") >= least)


#: Fields of a project's declared semantics and their kinds (fixed values).
SEMANTICS = {
    "nonProductionPatterns": list, "barrelFiles": list, "additionalTestPatterns": list, "customAssertionPatterns": list, "architecturalLayers": dict, "suggestedDepth": int,
}


def semantics(text: str | None) -> dict | None:
    """Declared semantics from the text of a file, None where there is none. What is wrong is said all at once: unknown fields, other kinds, empty texts or such that leave the project, a depth not from 1 to 5."""
    if text is None:
        return None
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("the semantics are no object")
    wrong = [f"{k}: unknown" for k in found if k not in SEMANTICS]

    def path_like(k: str, x: object) -> None:
        if not isinstance(x, str) or not x.strip() or x.startswith("/") or ".." in x.split("/"):
            wrong.append(f"{k}: {x!r} is no path or pattern inside the project")

    for k, kind in SEMANTICS.items():
        v = found.get(k)
        if k not in found:
            continue
        if not isinstance(v, kind) or isinstance(v, bool):
            wrong.append(f"{k}: no {kind.__name__}")
        elif kind is int and not 1 <= v <= 5:
            wrong.append(f"{k}: not from 1 to 5")
        elif kind is not int:
            for x in v:
                path_like(k, x)
            if kind is dict:
                wrong += [f"{k}.{x}: no text" for x, y in v.items() if not isinstance(y, str)]
    if wrong:
        raise ValueError("invalid semantics:\n" + "\n".join(f"  - {w}" for w in wrong))
    return found
