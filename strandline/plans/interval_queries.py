"""Range joins, islands, depth and coordinate maps over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from .registry import query, table

#: Price bands, the regions of the range-join query (fixed values).
BANDS = [("low", 0.0, 50000.0), ("mid", 60000.0, 150000.0), ("high", 150000.0, 300000.0), ("top", 320000.0, 1e9)]
_BANDS_SQL = ", ".join(f"('{n}', {a}, {b})" for n, a, b in BANDS)


def _event_intervals(spark, sf):
    """Each event as [begin, end) in whole seconds: it lasts its value."""
    e = table(spark, sf, "events")
    begin = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", begin.alias("begin"), (begin + F.ceil("value")).alias("end"))


_EVENTS = "WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS b, CAST(floor(epoch(ts)) + ceil(value) AS BIGINT) AS f FROM events)"


@query("j04_region_join", f"SELECT o_orderkey, band FROM orders JOIN (VALUES {_BANDS_SQL}) v(band, a, b) ON o_totalprice >= a AND o_totalprice < b")
def region_join(spark, sf):
    bands = spark.createDataFrame(BANDS, "band string, a double, b double")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return intervals.point_in_region(orders, bands, "o_totalprice", "a", "b", 50000.0).select("o_orderkey", "band")


@query("j05_region_semi", f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM (VALUES {_BANDS_SQL}) v(band, a, b) WHERE o_totalprice >= a AND o_totalprice < b)")
def region_semi(spark, sf):
    bands = spark.createDataFrame(BANDS, "band string, a double, b double")
    return intervals.point_in_region(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "a", "b", 50000.0, how="left_semi").select("o_orderkey")


@query("j06_overlap", f"{_EVENTS} SELECT x.user_id, x.event_id AS a_id, y.event_id AS b_id FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.b < y.f AND y.b < x.f")
def overlap(spark, sf):
    e = _event_intervals(spark, sf)
    a, b = e.select("user_id", F.col("event_id").alias("a_id"), F.col("begin").alias("a0"), F.col("end").alias("a1")), e.select("user_id", F.col("event_id").alias("b_id"), F.col("begin").alias("b0"), F.col("end").alias("b1"))
    return intervals.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 600).filter("a_id < b_id").select("user_id", "a_id", "b_id")


@query("j11_contains", f"{_EVENTS} SELECT x.user_id, x.event_id AS outer_id, y.event_id AS inner_id FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id <> y.event_id AND x.b <= y.b AND y.f <= x.f")
def contains(spark, sf):
    e = _event_intervals(spark, sf)
    a, b = e.select("user_id", F.col("event_id").alias("outer_id"), F.col("begin").alias("a0"), F.col("end").alias("a1")), e.select("user_id", F.col("event_id").alias("inner_id"), F.col("begin").alias("b0"), F.col("end").alias("b1"))
    return intervals.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 600, contains=True).filter("outer_id <> inner_id").select("user_id", "outer_id", "inner_id")


@query("j08_band", f"{_EVENTS} SELECT x.user_id, x.event_id AS later, y.event_id AS earlier, x.b - y.b AS apart FROM e x JOIN e y ON x.user_id = y.user_id AND x.b - y.b BETWEEN 0 AND 600 AND (x.b > y.b OR x.event_id > y.event_id)")
def band(spark, sf):
    return intervals.band_join(_event_intervals(spark, sf), ["user_id"], "begin", 600, "event_id")


@query(
    "a11_islands",
    f"""{_EVENTS}, m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY b, f, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf FROM e),
i AS (SELECT *, sum(CASE WHEN pf IS NULL OR b > pf THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, f, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, min(b) AS "begin", max(f) AS "end", count(*) AS members FROM i GROUP BY user_id, island""",
)
def islands(spark, sf):
    return intervals.islands(_event_intervals(spark, sf), ["user_id"], "begin", "end", "event_id")


@query(
    "g01_closure",
    f"""{_EVENTS}, m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY b, f, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf FROM e),
i AS (SELECT *, sum(CASE WHEN pf IS NULL OR b > pf THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, f, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY f - b DESC, b, event_id) AS k, count(*) OVER (PARTITION BY user_id, island) AS members FROM i)
SELECT user_id, CAST(island AS BIGINT) AS island, event_id AS winner, f - b AS length, members FROM r WHERE k = 1""",
)
def closure(spark, sf):
    return intervals.closure_winner(_event_intervals(spark, sf), ["user_id"], "begin", "end", "event_id")


@query(
    "a13_depth",
    f"""{_EVENTS}, s AS (SELECT user_id, b AS pos, 1 AS step FROM e UNION ALL SELECT user_id, f, -1 FROM e),
g AS (SELECT user_id, pos, sum(step) AS step FROM s GROUP BY ALL),
d AS (SELECT user_id, pos, sum(step) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM g)
SELECT user_id, CAST(max(depth) AS BIGINT) AS max_depth, count(*) AS changes FROM d GROUP BY user_id""",
)
def depth(spark, sf):
    return intervals.depth(_event_intervals(spark, sf), ["user_id"], "begin", "end").groupBy("user_id").agg(F.max("depth").alias("max_depth"), F.count("*").alias("changes"))


@query("w08_bins", "SELECT doc_id, CAST(b AS BIGINT) AS \"begin\", CAST(least(b + 1000, n_chars) AS BIGINT) AS \"end\" FROM documents, unnest(generate_series(0, greatest(n_chars - 1, 0), 1000)) u(b)")
def fixed_bins(spark, sf):
    d = intervals.fixed_bins(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 1000)
    return d.select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


@query(
    "j12_theta",
    "SELECT d.p_partkey AS donor, a.p_partkey AS acceptor FROM part d JOIN part a ON d.p_brand = a.p_brand AND d.p_type = a.p_type AND a.p_size - d.p_size BETWEEN 1 AND 5",
)
def theta(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return intervals.step_join(p, ["p_brand", "p_type"], "p_size", 1, 5, "p_partkey").select(F.col("earlier").alias("donor"), F.col("later").alias("acceptor"))


@query(
    "j09_exact_junction",
    "SELECT o_orderkey, coalesce(d, 0) AS depth FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey",
)
def exact_junction(spark, sf):
    d = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("d"))
    return table(spark, sf, "orders").select("o_orderkey").join(d, "o_orderkey", "left").select("o_orderkey", F.coalesce("d", F.lit(0)).alias("depth"))


@query(
    "j17_full_outer",
    "SELECT CASE WHEN d.doc_id IS NULL THEN 'right' WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
)
def full_outer(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("d"))
    both = d.join(table(spark, sf, "labels").select(F.col("doc_id").alias("l")), F.col("d") == F.col("l"), "full_outer")
    side = F.when(F.col("d").isNull(), "right").when(F.col("l").isNull(), "left").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("u04_only_left", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def only_left(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "j03_population",
    "SELECT n_name, r_name, count(c_custkey) AS samples FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
)
def population(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("samples"))
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("samples", F.lit(0)).alias("samples"))


@query(
    "g03_rebuild",
    """
WITH x AS (SELECT l_orderkey AS seq, l_linenumber, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL),
e AS (SELECT seq, l_linenumber * 100 AS pos, q % 4 AS r, q % 7 AS a FROM x)
SELECT seq, pos, CAST(coalesce(sum(r - a) OVER w, 0) AS BIGINT) AS delta, CAST(pos - coalesce(sum(r - a) OVER w, 0) AS BIGINT) AS alt_pos
FROM e WINDOW w AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
)
def rebuild_coordinates(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), "l_linenumber").agg(F.max(F.col("l_quantity").cast("long")).alias("q"))
    e = x.select("seq", (F.col("l_linenumber") * 100).alias("pos"), F.repeat(F.lit("A"), (F.col("q") % 4).cast("int")).alias("ref"), F.repeat(F.lit("C"), (F.col("q") % 7).cast("int")).alias("alt"))
    return intervals.apply_edits(e, ["seq"], "pos", "ref", "alt").select("seq", "pos", F.col("delta").cast("long").alias("delta"), F.col("alt_pos").cast("long").alias("alt_pos"))
