"""Scratch space that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where the session names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="strandline-"))
        found = _own[0]
    return found.rstrip("/")
