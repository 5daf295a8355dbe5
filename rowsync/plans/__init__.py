"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_rowsync_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "rowsync_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(path)
    sc._rowsync_shipped = True
