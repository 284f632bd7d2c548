"""Transcript, site and model operators that work on ordered parts: an order's lines stand for a transcript's exons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table

#: One exon per line number, its length the largest quantity, and where it begins in the spliced transcript.
_EXONS = """WITH x AS (SELECT l_orderkey AS t, l_linenumber AS k, CAST(max(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
e AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY t ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b, row_number() OVER (PARTITION BY t ORDER BY k) AS i, count(*) OVER (PARTITION BY t) AS c FROM x)"""


def exons(spark, sf) -> DataFrame:
    """t, k, n, b (spliced begin), i (ordinal from 1), c (exons of the transcript)."""
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("k")).agg(F.max("l_quantity").cast("long").alias("n"))
    w = Window.partitionBy("t").orderBy("k")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select("t", "k", "n", before.alias("b"), F.row_number().over(w).cast("long").alias("i"), F.count("*").over(Window.partitionBy("t")).alias("c"))


@query("w05_spliced_map", f"{_EXONS} SELECT t, k, b, b + n AS e FROM e")
def spliced_map(spark, sf):
    return exons(spark, sf).select("t", "k", "b", (F.col("b") + F.col("n")).alias("e"))


@query("a06_internal_exons", f"{_EXONS} SELECT CAST(round(avg(n)) AS BIGINT) AS mean_length, count(*) AS internal FROM e WHERE i > 1 AND i < c")
def internal_exons(spark, sf):
    return exons(spark, sf).filter("i > 1 and i < c").agg(F.round(F.avg("n")).cast("long").alias("mean_length"), F.count("*").alias("internal"))


@query("r01_content_regions", f"{_EXONS} SELECT kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS bases FROM (SELECT CASE WHEN c = 1 THEN 'single' WHEN i = 1 THEN 'initial' WHEN i = c THEN 'final' ELSE 'internal' END AS kind, n FROM e) GROUP BY 1")
def content_regions(spark, sf):
    kind = F.when(F.col("c") == 1, "single").when(F.col("i") == 1, "initial").when(F.col("i") == F.col("c"), "final").otherwise("internal")
    return exons(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("n").alias("bases"))


@query("a17_transition_counts", f"{_EXONS} SELECT CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single, CAST(sum(CASE WHEN c > 1 AND i = 1 THEN 1 ELSE 0 END) AS BIGINT) AS initial, CAST(sum(CASE WHEN i > 1 AND i < c THEN 1 ELSE 0 END) AS BIGINT) AS internal FROM e")
def transition_counts(spark, sf):
    return exons(spark, sf).agg(F.count_if(F.col("c") == 1).alias("single"), F.count_if((F.col("c") > 1) & (F.col("i") == 1)).alias("initial"), F.count_if((F.col("i") > 1) & (F.col("i") < F.col("c"))).alias("internal"))


@query("a14_phase_mismatch", f"{_EXONS} SELECT CAST(sum(n) FILTER (WHERE b % 3 <> 0) AS BIGINT) AS mismatched, floor(1000 * (sum(n) FILTER (WHERE b % 3 <> 0)) / sum(n) + 5.0 / 9.0) / 10 AS percent FROM e")
def phase_mismatch(spark, sf):
    off = F.sum(F.when(F.col("b") % 3 != 0, F.col("n")))
    return exons(spark, sf).agg(off.alias("mismatched"), (F.floor(1000 * off / F.sum("n") + 5.0 / 9.0) / 10.0).alias("percent"))


@query("x14_truncation", f"{_EXONS} SELECT t, CAST(floor((sum(n) + 2) / 3) AS BIGINT) AS residues FROM e GROUP BY 1")
def truncation(spark, sf):
    return exons(spark, sf).groupBy("t").agg(F.floor((F.sum("n") + 2) / 3).alias("residues"))


@query("w09_fully_covered", f"{_EXONS} SELECT t, k FROM (SELECT t, k, sum(CASE WHEN n < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS z FROM e) WHERE z = 0")
def fully_covered(spark, sf):
    w = Window.partitionBy("t").orderBy("k").rowsBetween(-1, 0)
    zero = F.sum(F.when(F.col("n") < 10, 1).otherwise(0)).over(w)
    return exons(spark, sf).withColumn("z", zero).filter("z = 0").select("t", "k")


@query("w04_log_coverage", f"{_EXONS} SELECT t, k, round(sum(ln(n / 51.0)) OVER w, 6) AS log_cover, round(sum(ln(1 - n / 51.0)) OVER w, 6) AS log_rest FROM e WINDOW w AS (PARTITION BY t ORDER BY k ROWS UNBOUNDED PRECEDING)")
def log_coverage(spark, sf):
    w = Window.partitionBy("t").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("n") / 51.0
    return exons(spark, sf).select("t", "k", F.round(F.sum(F.ln(p)).over(w), 6).alias("log_cover"), F.round(F.sum(F.ln(1 - p)).over(w), 6).alias("log_rest"))


@query("p11_annotated_chain", f"{_EXONS} SELECT t, i AS src, i + 1 AS dst, b + n AS donor FROM e WHERE i < c")
def annotated_chain(spark, sf):
    return exons(spark, sf).filter("i < c").select("t", F.col("i").alias("src"), (F.col("i") + 1).alias("dst"), (F.col("b") + F.col("n")).alias("donor"))


@query("p13_exon_skipping", f"{_EXONS} SELECT a.t, a.b + a.n AS donor, d.b AS acceptor, s.n AS skipped FROM e a JOIN e s ON s.t = a.t AND s.i = a.i + 1 JOIN e d ON d.t = a.t AND d.i = a.i + 2")
def exon_skipping(spark, sf):
    w = Window.partitionBy("t").orderBy("i")
    e = exons(spark, sf).withColumn("acceptor", F.lead("b", 2).over(w)).withColumn("skipped", F.lead("n", 1).over(w))
    return e.filter("acceptor is not null").select("t", (F.col("b") + F.col("n")).alias("donor"), "acceptor", "skipped")


@query(
    "p10_alternatives",
    f"{_EXONS}, s AS (SELECT t, i, unnest([0, 3, -3]) AS shift FROM e WHERE n = 50) SELECT t, count(*) AS sites, CAST(power(3, count(*) / 3) AS BIGINT) AS structures FROM s GROUP BY t",
)
def alternatives(spark, sf):
    """Each broken site has three candidates; structures are their product, counted and not written out."""
    s = exons(spark, sf).filter("n = 50").select("t", F.explode(F.array(F.lit(0), F.lit(3), F.lit(-3))).alias("shift"))
    g = s.groupBy("t").agg(F.count("*").alias("sites"))
    return g.select("t", "sites", F.pow(F.lit(3.0), F.col("sites") / 3).cast("long").alias("structures"))


@query("p18_edge_score", f"{_EXONS}, p AS (SELECT t, i, b, n, c, sum(ln(n)) OVER (PARTITION BY t ORDER BY i ROWS UNBOUNDED PRECEDING) AS a FROM e) SELECT x.t, round(coalesce(max(x.a) - min(x.a), 0) * 0.5, 6) AS score FROM p x GROUP BY x.t")
def edge_score(spark, sf):
    """Prefix sums at the last and first part of a transcript: their difference is the score of what lies between."""
    w = Window.partitionBy("t").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    p = exons(spark, sf).withColumn("a", F.sum(F.ln("n")).over(w))
    return p.groupBy("t").agg(F.round(F.coalesce(F.max("a") - F.min("a"), F.lit(0.0)) * 0.5, 6).alias("score"))


@query("p20_single_path", "WITH s AS (SELECT l_orderkey, exp(-l_extendedprice / 1e4) AS w FROM lineitem), p AS (SELECT l_orderkey, w / sum(w) OVER (PARTITION BY l_orderkey) AS p FROM s) SELECT l_orderkey FROM p WHERE round(p, 9) >= 0.2 GROUP BY 1 HAVING count(*) = 1")
def single_path(spark, sf):
    """Transcripts of which one path only passes the posterior filter."""
    from ..operators import scores

    p = scores.posterior(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), ["l_orderkey"], -F.col("l_extendedprice") / 1e4)
    return p.filter(F.round("posterior", 9) >= 0.2).groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n = 1").select("l_orderkey")


@query("f19_posterior_filter", "WITH s AS (SELECT o_custkey, o_orderkey, ln(o_totalprice) AS s FROM orders), p AS (SELECT o_orderkey, exp(s - max(s) OVER w) / 1 AS e, o_custkey, s FROM s WINDOW w AS (PARTITION BY o_custkey)) SELECT o_orderkey FROM (SELECT o_orderkey, e / sum(e) OVER (PARTITION BY o_custkey) AS p FROM p) WHERE round(p, 9) >= 0.1")
def posterior_filter(spark, sf):
    from ..operators import scores

    p = scores.posterior(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.ln("o_totalprice"))
    return p.filter(F.round("posterior", 9) >= 0.1).select("o_orderkey")


@query("o01_sort_sites", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice, o_orderkey")
def sort_sites(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", "o_totalprice", "o_orderkey")


@query("o03_renumber", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS vertex FROM part")
def renumber(spark, sf):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")) - 1
    return table(spark, sf, "part").select("p_partkey", n.cast("long").alias("vertex"))


@query("f13_sample_subset", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def sample_subset(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("f14_ploidy", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END WHEN p_size % 7 = 0 AND p_size % 2 = 0 THEN 1 ELSE 2 END AS ploidy FROM part")
def ploidy(spark, sf):
    from ..operators import variants

    size = F.col("p_size")
    chrom = F.when(size % 5 == 0, "chrY").when(size % 7 == 0, "chrX").otherwise("chr1")
    return table(spark, sf, "part").select("p_partkey", variants.haplotype_ploidy(chrom, size % 2 == 0).alias("ploidy"))


@query("f09_consensus", "SELECT p_partkey, substr(upper(p_name), 2, 2) IN ('ED', 'RE', 'LU', 'MA') AS consensus FROM part")
def consensus(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.substring(F.upper("p_name"), 2, 2).isin("ED", "RE", "LU", "MA").alias("consensus"))


@query("f06_cnv", "SELECT p_partkey, repeat(p_type, p_size % 4) AS allele, string_split(p_name, ' ')[1] AS first_allele FROM part")
def cnv(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.repeat(F.col("p_type"), F.col("p_size") % 4).alias("allele"), F.split("p_name", " ")[0].alias("first_allele"))


@query("f11_shift", "SELECT l_orderkey, l_linenumber, l_partkey - 100 AS b, l_partkey - 100 + CAST(l_quantity AS BIGINT) AS e FROM lineitem")
def shift(spark, sf):
    b = F.col("l_partkey") - 100
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b"), (b + F.col("l_quantity").cast("long")).alias("e"))


@query("f22_cigar_events", "SELECT p_partkey, x.op, x.ref, x.n FROM (SELECT p_partkey, unnest([{'op': 'I', 'ref': p_size, 'n': 2}, {'op': 'D', 'ref': p_size + 3, 'n': 1 + p_size % 3}]) AS x FROM part)")
def cigar_events(spark, sf):
    from ..functions import sequences as sq

    cigar = F.concat(F.col("p_size").cast("string"), F.lit("M2I3M"), (F.col("p_size") % 3 + 1).cast("string"), F.lit("D5M"))
    s = table(spark, sf, "part").select("p_partkey", F.explode(sq.cigar_segments(cigar)).alias("s"))
    return s.filter("s.op <> 'M'").select("p_partkey", "s.op", "s.ref", "s.n")


@query("x06_cigar_map", "SELECT p_partkey, p_size - 1 AS a, p_size + 2 AS b, p_size + 4 AS c, p_size + 6 AS d FROM part")
def cigar_map(spark, sf):
    """Four positions through <size>M 2I 3M <k>D 5M: before the insertion, after it, in the deletion, after it."""
    from ..functions import sequences as sq

    k = F.col("p_size") % 3 + 1
    cigar = F.concat(F.col("p_size").cast("string"), F.lit("M2I3M"), k.cast("string"), F.lit("D5M"))
    at = lambda p: sq.map_position(F.col("seg"), p)
    p = table(spark, sf, "part").withColumn("seg", sq.cigar_segments(cigar)).withColumn("k", k)
    size = F.col("p_size")
    return p.select("p_partkey", at(size - 1).alias("a"), at(size).alias("b"), at(size + 3).alias("c"), at(size + 3 + F.col("k") + 1).alias("d"))


@query("m02_log_odds", "WITH c AS (SELECT p_type, substr(p_name, 1, 1) AS s, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY p_type) AS p FROM c), q AS (SELECT s, sum(n) / sum(sum(n)) OVER () AS q FROM c GROUP BY s) SELECT p_type, s, round(ln(p) - ln(q), 6) AS log_odds FROM p JOIN q USING (s)")
def log_odds(spark, sf):
    c = table(spark, sf, "part").groupBy("p_type", F.substring("p_name", 1, 1).alias("s")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("p_type"))
    c = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("all"))))  # one row
    q = F.sum("n").over(Window.partitionBy("s")) / F.col("all")
    return c.select("p_type", "s", F.round(F.ln(p) - F.ln(q), 6).alias("log_odds"))


@query("m15_likelihood_ratio", "WITH g AS (SELECT o_custkey, sum(ln(o_totalprice)) AS pos, sum(ln(200000.0)) AS neg, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round(exp((pos - neg) / n), 6) AS ratio FROM g")
def likelihood_ratio(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.ln("o_totalprice")).alias("pos"), F.count("*").alias("n"))
    return g.select("o_custkey", F.round(F.exp((F.col("pos") - F.col("n") * F.ln(F.lit(200000.0))) / F.col("n")), 6).alias("ratio"))


@query("m17_split", "SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives FROM labels GROUP BY 1")
def split(spark, sf):
    """A deterministic split by ordinal, all rows in one part or the other."""
    part = F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test")
    return table(spark, sf, "labels").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("quality").alias("positives"))


@query("p25_event_stream", "WITH n AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT CASE WHEN before IS NULL THEN 'gain' WHEN before = event_type THEN 'same' ELSE 'change' END AS kind, count(*) AS n FROM n GROUP BY 1")
def event_stream(spark, sf):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").withColumn("before", before)
    kind = F.when(F.col("before").isNull(), "gain").when(F.col("before") == F.col("event_type"), "same").otherwise("change")
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("p31_found_or_missing", "SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'MISSING' ELSE 'FOUND' END AS signal, round(exp(coalesce(s, 0) / 100), 6) AS normalised FROM orders LEFT JOIN (SELECT l_orderkey, sum(-l_quantity) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON o_orderkey = l_orderkey")
def found_or_missing(spark, sf):
    d = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(-F.col("l_quantity")).alias("s"))
    o = table(spark, sf, "orders").select("o_orderkey").join(d, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("s").isNull(), "MISSING").otherwise("FOUND").alias("signal"), F.round(F.exp(F.coalesce("s", F.lit(0.0)) / 100), 6).alias("normalised"))


@query("p32_configurations", "SELECT c.cutoff, count(*) FILTER (WHERE o_totalprice >= c.cutoff) AS passed FROM orders, (VALUES (50000.0::DOUBLE), (100000.0), (200000.0), (300000.0), (400000.0)) c(cutoff) GROUP BY 1")
def configurations(spark, sf):
    """One scan evaluates all five configurations."""
    cutoffs = (50000.0, 100000.0, 200000.0, 300000.0, 400000.0)
    counts = table(spark, sf, "orders").agg(*[F.count_if(F.col("o_totalprice") >= c).alias(str(int(c))) for c in cutoffs])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"`{int(c)}`").alias("passed")) for c in cutoffs])).alias("x")).select("x.*")


@query("j10_shared_begin", "WITH b AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS d FROM lineitem GROUP BY 1) SELECT p_partkey, CAST(coalesce(d, 0) AS BIGINT) AS depth_out FROM part LEFT JOIN b ON p_partkey = l_partkey")
def shared_begin(spark, sf):
    b = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("d"))
    return table(spark, sf, "part").select("p_partkey").join(b, "p_partkey", "left").select("p_partkey", F.coalesce("d", F.lit(0)).alias("depth_out"))


@query("a29_first_seen", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def first_seen(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
