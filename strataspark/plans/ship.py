"""Making the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources (some 200 kB) to the executors, once in a context; nothing happens if it lies in an archive already."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if getattr(sc, "_strataspark_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="strataspark-")) / "strataspark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._strataspark_shipped = True
