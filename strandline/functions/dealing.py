"""Rows dealt out by key into a number of parts that grows with them, so that a task's memory doesn't."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Rows of a part that keys are dealt out to.
PART_ROWS = 1 << 17


def parts_for(df: DataFrame, rows: int | None = None) -> int:
    """Parts of about `rows` (PART_ROWS) rows each; they are counted first (from the footers, where df is a table's columns)."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism, math.ceil(df.count() / (rows or PART_ROWS)))


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt out by keys; what is grouped by them then stays where it is. Parts whose number is given aren't merged for
    their size, so what unfolds from few bytes isn't left to a few tasks."""
    return df.repartition(parts_for(df, rows), *keys)
