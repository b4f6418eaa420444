"""Enough partitions for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, over at least as many partitions as there are cores.

    Few large files that cannot be split would leave cores idle in work that
    costs much per row. Where the files give partitions enough, nothing is
    moved. Only for tables that are just read: planning must cost no job.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
