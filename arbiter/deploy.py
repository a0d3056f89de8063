"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this application, once."""
    context = spark.sparkContext
    if getattr(context, "_arbiter_shipped", False):
        return
    package = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="arbiter-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(path)
    context._arbiter_shipped = True
