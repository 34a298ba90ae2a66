"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_kham_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    if not str(root).endswith(".zip") and root.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="kham-ship-"), "kham_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(path)
    sc._kham_shipped = True
    return spark
