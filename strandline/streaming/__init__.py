"""Unbounded inputs: the status summary over a stream of reports, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_summary(stream: DataFrame, code: str, when: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per code and tumbling window of event time; rows later than `late` are left out."""
    return stream.withWatermark(when, late).groupBy(F.window(when, window).alias("w"), code).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), code, "n")
