"""Sends this package's Python files to the executors, for functions that run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once per context: executors then import the package wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_strandline_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="strandline-code-")) / "strandline.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, f"{PACKAGE.name}/{file.relative_to(PACKAGE)}")
    context.addPyFile(str(path))
    context._strandline_shipped = True
