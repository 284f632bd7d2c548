"""Splice analysis: consequences as column logic, and graphs as edge tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch

#: Distance in bases from the stop to the last exon junction from which decay is predicted (fixed value).
NMD_DISTANCE = 50
#: Partial paths kept per vertex at most (fixed value).
QUEUE = 100


def nmd_fate(exon_lengths: Column, stop: Column) -> Column:
    """NO_START without exons, NO_STOP without a stop, NMD when the last junction lies NMD_DISTANCE or more after it."""
    n = F.size(exon_lengths)
    junction = F.aggregate(F.slice(exon_lengths, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(n == 0, "NO_START").when(stop.isNull() | (stop < 0), "NO_STOP").when((n > 1) & (junction - stop >= NMD_DISTANCE), "NMD").otherwise("NONE")


def site_change(ref_score: Column, alt_score: Column, cutoff: Column, consensus_kept: Column) -> Column:
    """broken: the consensus is gone; weakened: from above to below the cutoff by a factor of two or more."""
    weakened = (ref_score >= cutoff) & (alt_score < cutoff) & (ref_score - alt_score >= F.ln(F.lit(2.0)))
    return F.when(~consensus_kept, "broken").when(weakened, "weakened").otherwise("intact")


def skip_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) two hops apart: what skipping the vertex between them joins."""
    a, b = edges.select(F.col("src"), F.col("dst").alias("via")), edges.select(F.col("src").alias("via"), F.col("dst"))
    return a.join(b, "via").filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count("*").alias("ways"))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables, edges and vertices."""
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a stored graph."""
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def reachable(edges: DataFrame, source: str, sink: str) -> DataFrame:
    """Vertices on some path from source to sink, of any length, through cycles too.

    Both ends advance one edge a pass. A pass keeps the distinct vertices that no earlier one met and writes them to the
    shared folder; it ends when there are none.
    """
    spark = edges.sparkSession
    root = f"{scratch(spark)}/reachable/{uuid.uuid4().hex}"
    written: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        path = f"{root}/{len(written)}"
        df.write.parquet(path)
        written.append(path)
        return spark.read.schema(df.schema).parquet(path)

    named = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).filter("src is not null and dst is not null")
    way = lambda end, a, b: named.select(F.lit(end).alias("end"), F.col(a).alias("v"), F.col(b).alias("to"))
    ways = put(way("source", "src", "dst").unionByName(way("sink", "dst", "src")).distinct())
    front = put(spark.createDataFrame([("source", source), ("sink", sink)], "end string, v string"))
    fronts = written[1:]
    while not front.isEmpty():
        met = spark.read.schema(front.schema).parquet(*fronts)
        ahead = front.join(ways, ["end", "v"]).select("end", F.col("to").alias("v")).distinct()
        front = put(ahead.join(met, ["end", "v"], "left_anti"))
        fronts.append(written[-1])
    met = spark.read.schema(front.schema).parquet(*fronts)
    return met.filter("end = 'source'").select("v").join(met.filter("end = 'sink'").select("v"), "v", "left_semi")


def trees(lines: Iterator[str]) -> Iterator[list]:
    """Nested lists of parenthesised records: (tag child ...)."""
    stack: list[list] = []
    for line in lines:
        for token in line.replace("(", " ( ").replace(")", " ) ").split():
            if token == "(":
                stack.append([])
            elif token == ")":
                done = stack.pop()
                if stack:
                    stack[-1].append(done)
                else:
                    yield done
            elif stack:
                stack[-1].append(token)
