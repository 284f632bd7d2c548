"""Report analytics, filters and aggregates over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, scores
from .registry import query, table


@query("a02_status_summary", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))")
def status_summary(spark, sf):
    return reports.status_summary(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "a01_major_class",
    """
WITH c AS (SELECT c_mktsegment AS site, r_name AS pop, o_orderpriority AS allele, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT site, pop, allele AS major, n FROM (SELECT *, row_number() OVER (PARTITION BY site, pop ORDER BY n DESC, allele) AS k FROM c) WHERE k = 1
""",
)
def major_class(spark, sf):
    """Customers, nations and regions are reduced to (customer, site, population) before they meet the orders."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("pop"))
    people = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("site"), "pop")
    counts = table(spark, sf, "orders").select("o_custkey", "o_orderpriority").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("site", "pop", F.col("o_orderpriority").alias("allele")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("allele").alias("allele")))
    return counts.groupBy("site", "pop").agg(best.alias("b")).select("site", "pop", F.col("b.allele").alias("major"), (-F.col("b.m")).alias("n"))


@query(
    "a03_tabulate",
    """
SELECT l_returnflag, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_orderkey END) AS discounted, count(DISTINCT CASE WHEN l_quantity >= 40 THEN l_orderkey END) AS large,
  round(sum(l_quantity), 2) AS total, round(sum(l_quantity * l_quantity), 2) AS squares, count(l_quantity) AS n FROM lineitem GROUP BY 1
""",
)
def tabulate(spark, sf):
    conditions = {"discounted": F.col("l_discount") > 0.05, "large": F.col("l_quantity") >= 40}
    t = reports.tabulate(table(spark, sf, "lineitem"), ["l_returnflag"], "l_orderkey", conditions, "l_quantity")
    return t.withColumns({"total": F.round("total", 2), "squares": F.round("squares", 2)})


@query(
    "a04_decision",
    """
WITH o AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS broken, max(l_discount) >= 0.1 AS nmd, count(*) < 2 AS truncated, bool_or(l_linestatus = 'F') AS changed FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN broken OR nmd OR truncated THEN 'loss' WHEN changed THEN 'altered' ELSE 'intact' END AS call,
  CASE WHEN broken THEN 'broken-site' WHEN nmd THEN 'NMD' WHEN truncated THEN 'truncation' WHEN changed THEN 'protein-differs' ELSE 'none' END AS reason FROM o
""",
)
def decision(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("broken"), (F.max("l_discount") >= 0.1).alias("nmd"),
        (F.count("*") < 2).alias("truncated"), F.bool_or(F.col("l_linestatus") == "F").alias("changed"),
    )
    call, reason = reports.loss_of_function(*(F.col(c) for c in ("broken", "nmd", "truncated", "changed")))
    return o.select("l_orderkey", call.alias("call"), reason.alias("reason"))


@query("a07_longest_per_group", "SELECT lang, doc_id, n AS length FROM (SELECT lang, doc_id, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS k FROM documents) WHERE k = 1")
def longest(spark, sf):
    d = table(spark, sf, "documents").select("lang", "doc_id", F.length("text").alias("n"))
    return scores.longest_per_group(d, ["lang"], F.col("n"), "doc_id").select("lang", "doc_id", F.col("length").cast("long").alias("length"))


@query(
    "a10_norm_mi",
    """
WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY ALL),
q AS (SELECT *, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM j),
t AS (SELECT sum(p * log2(p / (pa * pb))) AS mi, -sum(p * log2(pa)) AS ha, -sum(p * log2(pb)) AS hb FROM q)
SELECT round(abs(mi), 6) AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(abs(coalesce(mi / nullif(sqrt(ha * hb), 0), 0)), 6) AS normalised FROM t
""",
)
def normalised_mi(spark, sf):
    t = reports.normalised_mutual_information(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return t.select(F.round(F.abs("mi"), 6).alias("mi"), F.round("ha", 6).alias("ha"), F.round("hb", 6).alias("hb"), F.round(F.abs("normalised"), 6).alias("normalised"))


@query(
    "a23_histogram",
    """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, l_returnflag FROM lineitem, e),
c AS (SELECT bin, count(*) FILTER (WHERE l_returnflag = 'R') + 0.01::DOUBLE AS p, count(*) + 1.0::DOUBLE AS q FROM b GROUP BY bin),
r AS (SELECT bin, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM c)
SELECT bin, round(p, 6) AS p, round(q, 6) AS q, round(ln(p / q), 6) AS log_ratio FROM r
""",
)
def histogram(spark, sf):
    h = reports.likelihood_histogram(table(spark, sf, "lineitem").select("l_extendedprice", "l_returnflag"), "l_extendedprice", F.col("l_returnflag") == "R", 20)
    return h.select(F.col("bin").cast("long").alias("bin"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), F.round("log_ratio", 6).alias("log_ratio"))


@query("a15_error_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS warnings FROM events GROUP BY 1")
def error_counts(spark, sf):
    is_type = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, sf, "events").groupBy("user_id").agg(is_type("error").alias("errors"), is_type("view").alias("warnings"))


@query("a26_ratios", "SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share_f, round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 6) AS share_large FROM orders GROUP BY 1")
def ratios(spark, sf):
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(share(F.col("o_orderstatus") == "F").alias("share_f"), share(F.col("o_totalprice") > 200000).alias("share_large"))


@query(
    "f16_first_per_key",
    """
SELECT c AS o_custkey, o_orderkey, o_orderstatus, seen FROM (SELECT o_custkey AS c, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS seen FROM orders)
WHERE k = 1 AND o_orderstatus <> 'P'
""",
)
def first_per_key(spark, sf):
    first = reports.first_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey"])
    return first.filter("o_orderstatus <> 'P'")


@query(
    "f18_path_query",
    "".join(
        f"{' UNION ALL ' if k else ''}SELECT '{op}' AS op, count(*) AS n FROM events WHERE {cond}"
        for k, (op, cond) in enumerate(
            {">": "CAST(props->>'$.k' AS DOUBLE) > 50", ">=": "CAST(props->>'$.k' AS DOUBLE) >= 50", "<": "CAST(props->>'$.k' AS DOUBLE) < 50", "<=": "CAST(props->>'$.k' AS DOUBLE) <= 50", "=": "CAST(props->>'$.k' AS DOUBLE) = 50", "!=": "CAST(props->>'$.k' AS DOUBLE) <> 50", "~": "contains(props->>'$.k', '50')"}.items()
        )
    ),
)
def path_query(spark, sf):
    """One scan counts all seven operators."""
    e = table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("k"))
    counts = e.agg(*[F.count_if(reports.path_filter(F.col("k"), op, "50")).alias(op) for op in reports.OPERATORS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"`{op}`").alias("n")) for op in reports.OPERATORS])).alias("x")).select("x.*")


@query("f01_site_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'O' AND l_discount BETWEEN 0.02 AND 0.06")
def site_filter(spark, sf):
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "N") & (F.col("l_linestatus") == "O") & F.col("l_discount").between(0.02, 0.06)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("f04_variable_sites", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R')")
def variable_sites(spark, sf):
    r = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(r).alias("a"), F.bool_or(~r).alias("b")).filter("a and b").select("l_orderkey")


@query("f05_site_ids", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN concat(p_brand, '@', CAST(p_size - 1 AS VARCHAR)) ELSE p_name END AS id, CASE WHEN starts_with(p_brand, 'Brand') THEN p_brand ELSE concat('Brand', p_brand) END AS chr, p_size - 1 AS pos FROM part")
def site_ids(spark, sf):
    made = F.concat("p_brand", F.lit("@"), (F.col("p_size") - 1).cast("string"))
    chrom = F.when(F.col("p_brand").startswith("Brand"), F.col("p_brand")).otherwise(F.concat(F.lit("Brand"), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, made).otherwise(F.col("p_name")).alias("id"), chrom.alias("chr"), (F.col("p_size") - 1).alias("pos"))


@query("f20_bands", "SELECT CASE WHEN l_discount <= 0.02 THEN 'a' WHEN l_discount <= 0.05 THEN 'b' WHEN l_discount <= 0.08 THEN 'c' ELSE 'd' END AS band, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def bands(spark, sf):
    d = F.col("l_discount")
    band = F.when(d <= 0.02, "a").when(d <= 0.05, "b").when(d <= 0.08, "c").otherwise("d")
    return table(spark, sf, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("u05_set_equal", "WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1) SELECT a.l_orderkey, a.s = b.s AS same FROM g a JOIN g b ON b.l_orderkey = a.l_orderkey + 1")
def set_equal(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))
    after = g.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("s").alias("t"))
    return g.join(after, "l_orderkey").select("l_orderkey", (F.col("s") == F.col("t")).alias("same"))


@query(
    "u03_dedupe_keep_last",
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
)
def keep_last(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


@query("j19_upsert_flag", "SELECT user_id, event_type, bool_or(value > 300) AS denovo, min(event_id) AS event_id FROM events GROUP BY ALL")
def upsert_flag(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 300).alias("denovo"), F.min("event_id").alias("event_id"))


@query(
    "s23_partition_sink",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def partition_sink(spark, sf):
    """Orders split into one folder per status and read back."""
    import uuid

    from ..sources.tables import scratch

    path = f"{scratch(spark)}/split-{uuid.uuid4().hex}"
    table(spark, sf, "orders").select("o_orderstatus", "o_totalprice").write.partitionBy("o_orderstatus").parquet(path)
    back = spark.read.schema("o_totalprice double, o_orderstatus string").parquet(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
