"""The project's tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import plain
from strataspark.plans.ship import ship


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table below a folder; scans prune columns and push filters as the plan asks."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def all_entities(spark: SparkSession, root: str) -> DataFrame:
    """Scoped and shared entities."""
    return table(spark, root, "entities").unionByName(table(spark, root, "shared_entities"))


def current_entities(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """One row per plain id among the entities that have not been removed: the latest lifetime, redeliveries folded.

    Rows are folded as a whole, so name the `columns` that are needed (default:
    all); the others are then neither read nor shuffled.
    """
    live = all_entities(spark, root).where(F.col("removed_at").isNull() & F.col("id").isNotNull())
    order = {"first_seen_at": F.col("first_seen_at"), "id": F.col("id"), "name": F.col("name"), "entity_type": F.col("entity_type"), "__file": F.col("source_location.file")}
    keyed = live.withColumn("key", plain("id"))
    if columns and "attributes" not in columns:  # maps have no order
        row = F.struct(*(c.alias(n) for n, c in order.items()), *(c for c in columns if c not in order))
        return keyed.groupBy("key").agg(F.max(row).alias("row")).select("key", *(f"row.{c}" for c in dict.fromkeys(columns)))
    newest = F.max_by(F.struct(*(columns or live.columns)), F.struct(*order.values()))
    return keyed.groupBy("key").agg(newest.alias("row")).select("key", "row.*")


def commit_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per scope, commit and path: redeliveries folded, renames and empty paths left out."""
    c = table(spark, root, "commit_files")
    ok = F.col("path").isNotNull() & (F.col("path") != "") & ~F.contains(F.col("path"), F.lit(" => "))
    return (
        c.where(ok & F.col("sha").isNotNull())
        .groupBy("scope_key", F.lower("sha").alias("sha"), "path")
        .agg(
            F.max(plain("author_email")).alias("author"),
            F.max("commit_date").alias("commit_date"),
            F.max("added").alias("added"),
            F.max("deleted").alias("deleted"),
        )
    )
