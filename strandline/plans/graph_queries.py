"""Splice consequences and graphs over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import splice_graph, splicing
from .registry import query, table

#: A small splice graph with dead ends (fixed values).
DAG = [("L", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "R"), ("c", "x"), ("y", "d"), ("b", "R"), ("x", "z")]
_DAG_SQL = ", ".join(f"('{a}', '{b}')" for a, b in DAG)


@query(
    "p02_site_change",
    """
WITH o AS (SELECT o_custkey, o_orderkey, ln(o_totalprice) AS s, o_orderpriority AS c, lag(ln(o_totalprice)) OVER w AS r, lag(o_orderpriority) OVER w AS rc FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CASE WHEN c <> rc AND c = '5-LOW' THEN 'broken' WHEN r >= ln(100000) AND s < ln(100000) AND r - s >= ln(2) THEN 'weakened' ELSE 'intact' END AS change FROM o WHERE r IS NOT NULL
""",
)
def site_change(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.ln("o_totalprice").alias("s"), F.col("o_orderpriority").alias("c"))
    o = o.withColumn("r", F.lag("s").over(w)).withColumn("rc", F.lag("c").over(w)).filter("r is not null")
    kept = ~((F.col("c") != F.col("rc")) & (F.col("c") == "5-LOW"))
    return o.select("o_orderkey", splicing.site_change(F.col("r"), F.col("s"), F.ln(F.lit(100000.0)), kept).alias("change"))


@query(
    "p03_nmd",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, count(*) AS n, sum(q) AS t, max_by(q, l_linenumber) AS last, CASE WHEN min(q) % 4 = 0 THEN NULL ELSE min(q) END AS stop FROM x GROUP BY 1)
SELECT l_orderkey, CASE WHEN stop IS NULL THEN 'NO_STOP' WHEN n > 1 AND t - last - stop >= 50 THEN 'NMD' ELSE 'NONE' END AS fate FROM g
""",
)
def nmd(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("long")).alias("q"))
    g = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("e"), F.min("q").alias("m"))
    stop = F.when(F.col("m") % 4 != 0, F.col("m"))
    return g.select("l_orderkey", splicing.nmd_fate(F.transform("e", lambda s: s["q"]), stop).alias("fate"))


@query(
    "p13_two_hop",
    """
WITH n AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT DISTINCT src, dst FROM n WHERE dst IS NOT NULL AND src <> dst)
SELECT a.src, b.dst, count(*) AS ways FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL
""",
)
def two_hop(spark, sf):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select(F.col("event_type").alias("src"), nxt.alias("dst")).filter("dst is not null and src <> dst").distinct()
    return splicing.skip_edges(e)


@query(
    "p17_reachable",
    """
WITH RECURSIVE e AS (SELECT CAST(c_custkey AS BIGINT) AS src, CAST(2 * c_custkey AS BIGINT) AS dst FROM customer UNION SELECT c_custkey, 2 * c_custkey + 1 FROM customer UNION SELECT c_custkey, c_custkey + c_nationkey FROM customer WHERE c_nationkey > 20),
f(v) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM f JOIN e ON e.src = f.v), b(v) AS (SELECT CAST(150 AS BIGINT) UNION SELECT e.src FROM b JOIN e ON e.dst = b.v)
SELECT CAST(v AS VARCHAR) AS v FROM f WHERE v IN (SELECT v FROM b)
""",
)
def reachable(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    to = F.explode(F.array_distinct(F.array(2 * k, 2 * k + 1, F.when(F.col("c_nationkey") > 20, k + F.col("c_nationkey")).otherwise(2 * k))))
    return splicing.reachable(c.select(k.alias("src"), to.alias("dst")), "1", "150")


@query(
    "p19_nbest",
    """
WITH s AS (SELECT o_orderstatus AS a, o_orderpriority AS b, c_mktsegment AS c, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
e0 AS (SELECT a AS src, b AS dst, ln(count(*)) AS w FROM s GROUP BY ALL), e1 AS (SELECT b AS src, c AS dst, ln(count(*)) AS w FROM s GROUP BY ALL),
p AS (SELECT concat(e0.src, '>', e0.dst, '>', e1.dst) AS path, e0.w + e1.w AS score FROM e0 JOIN e1 ON e0.dst = e1.src)
SELECT path, round(score, 6) AS score FROM p ORDER BY round(score, 9) DESC, path LIMIT 10
""",
)
def nbest(spark, sf):
    s = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    layer = lambda a, b: s.groupBy(F.col(a).alias("src"), F.col(b).alias("dst")).agg(F.ln(F.count("*")).alias("score"))
    edges = layer("o_orderstatus", "o_orderpriority").unionByName(layer("o_orderpriority", "c_mktsegment"))
    paths = splice_graph.best_paths(edges.withColumns({"g": F.lit(0), "annotated": F.lit(True)}), "g", 10)  # one graph, of as many edges as pairs of classes
    return paths.select("path", F.round("score", 6).alias("score"))
