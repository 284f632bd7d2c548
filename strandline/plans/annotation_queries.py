"""Annotation operators, report filters and exports, and positional models over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import annotations, models, reports
from .registry import query, table
from .sequence_queries import _BASES


@query("f10_biotype_filter", "SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'exon' ELSE 'CDS' END AS f FROM lineitem) t WHERE l_returnflag IN ('A', 'N') AND NOT (l_returnflag = 'N' AND f = 'exon')")
def biotype_filter(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("f", F.when(F.col("l_linestatus") == "O", "exon").otherwise("CDS"))
    return annotations.of_biotypes(t, "l_returnflag", "f", ["A", "N"], "N").select("l_orderkey", "l_linenumber")


@query("f12_substrate_prefix", "SELECT n_nationkey, CASE WHEN starts_with(n_name, 'I') THEN n_name ELSE concat('I', n_name) END AS name FROM nation")
def substrate_prefix(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", annotations.with_prefix(F.col("n_name"), "I").alias("name"))


@query("f21_normal_biotype", "SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE 'noncoding' END AS biotype, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def normal_biotype(spark, sf):
    e = table(spark, sf, "events").filter("event_type is not null")
    return e.groupBy(annotations.normal_biotype(F.col("event_type"), ["purchase", "signup"]).alias("biotype")).agg(F.count("*").alias("n"))


@query(
    "f15_report_filter",
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_totalprice <= 150000 AND o_orderstatus = 'F') t WHERE k = 1",
)
def report_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    good = reports.without_errors(o, F.col("o_orderpriority") == "1-URGENT", "o_totalprice", 150000)
    return reports.first_of_transcript(reports.of_gene(good, "o_orderstatus", "F"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("a28_descendants", "SELECT event_id, CAST(len(regexp_extract_all(props, '\"k\"\\s*:')) AS INT) AS n FROM events")
def descendants(spark, sf):
    return table(spark, sf, "events").select("event_id", reports.descendants(F.col("props"), "k").alias("n"))


@query("f17_tree_query", "SELECT event_id FROM events WHERE len(regexp_extract_all(props, '\"k\"\\s*:')) > 0")
def tree_query(spark, sf):
    return table(spark, sf, "events").filter(reports.descendants(F.col("props"), "k") > 0).select("event_id")


@query("p30_tsv", "SELECT concat_ws(chr(9), c_custkey, c_name, c_mktsegment, c_nationkey) AS line FROM customer")
def tsv(spark, sf):
    return reports.to_tsv(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])


@query("p30_gff", """SELECT concat_ws(chr(9), p_brand, 'strandline', p_type, CAST(p_size + 1 AS VARCHAR), CAST(p_size + 10 AS VARCHAR), '.', '+', '.', concat('gene_id "', p_brand, '"; transcript_id "', p_partkey, '";')) AS line FROM part""")
def gff(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_size", "p_partkey", (F.col("p_size") + 10).alias("e"), F.lit("+").alias("strand"))
    return reports.to_gff(p, "p_brand", "strandline", "p_type", "p_size", "e", "strand", {"gene_id": "p_brand", "transcript_id": "p_partkey"})


@query("s14_xml", "SELECT concat('<nation><n_nationkey>', n_nationkey, '</n_nationkey><n_name>', replace(replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</n_name></nation>') AS line FROM nation")
def xml(spark, sf):
    return reports.to_xml(table(spark, sf, "nation"), "nation", ["n_nationkey", "n_name"])


@query(
    "s12_region_read",
    "SELECT doc_id, CAST(length(text) // 3 AS BIGINT) AS b, substr(text, length(text) // 3 + 1, 700) AS seq FROM documents WHERE length(text) > 0",
)
def region_read(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    b = F.floor(F.length("text") / 3)
    regions = d.filter("length(text) > 0").select("doc_id", b.alias("b"), (b + 700).alias("e"))
    return annotations.read_regions(annotations.slices(d, "doc_id", "text", 500), regions, "doc_id", "b", "e", 500).select("doc_id", "b", "seq")


@query(
    "a12_differing_runs",
    """
WITH p AS (SELECT p_partkey, p_name AS a, reverse(p_name) AS b FROM part),
x AS (SELECT p_partkey, i - 1 AS pos FROM p, unnest(generate_series(1, length(a))) u(i) WHERE substr(a, CAST(i AS INT), 1) <> substr(b, CAST(i AS INT), 1)),
y AS (SELECT p_partkey, pos, pos - row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS run FROM x)
SELECT p_partkey, CAST(min(pos) AS INT) AS "begin", CAST(max(pos) + 1 AS INT) AS "end" FROM y GROUP BY p_partkey, run
""",
)
def differing_runs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"), F.reverse("p_name").alias("b"))
    return annotations.differing_runs(p, "p_partkey", "a", "b")


@query(
    "r01_tiled_regions",
    """
WITH l AS (SELECT l_orderkey AS t, l_linenumber * 100 AS b, l_linenumber * 100 + CAST(l_quantity AS INT) AS e FROM lineitem),
x AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY b, e) AS i, count(*) OVER (PARTITION BY t) AS n, lead(b) OVER (PARTITION BY t ORDER BY b, e) AS nx FROM l)
SELECT t, CASE WHEN n = 1 THEN 'single-exon' WHEN i = 1 THEN 'initial-exon' WHEN i = n THEN 'final-exon' ELSE 'internal-exon' END AS kind, b AS "begin", e AS "end" FROM x
UNION ALL SELECT t, 'intron', e, nx FROM x WHERE nx > e
""",
)
def tiled_regions(spark, sf):
    at = F.col("l_linenumber") * 100
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t"), at.alias("b"), (at + F.col("l_quantity").cast("int")).alias("e"))
    return annotations.tile(parts, "t", "b", "e")


@query(
    "j16_linkage",
    """
WITH t AS (SELECT CAST(x.l_returnflag = 'R' AS INT) AS a, CAST(y.l_linestatus = 'F' AS INT) AS b FROM lineitem x JOIN lineitem y USING (l_orderkey, l_linenumber)),
m AS (SELECT count(*) AS n, avg(a) AS pa, avg(b) AS pb, avg(a * b) AS pab FROM t)
SELECT n, round(pab - pa * pb, 9) AS d, round((pab - pa * pb) * (pab - pa * pb) / nullif(pa * (1 - pa) * pb * (1 - pb), 0), 9) AS r2 FROM m
""",
)
def linkage(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("a"), (F.col("l_linestatus") == "F").cast("int").alias("b"))
    return annotations.linkage(l, l, ["l_orderkey", "l_linenumber"], "a", "b").select("n", F.round("d", 9).alias("d"), F.round("r2", 9).alias("r2"))


@query("s16_labels", "SELECT p_brand AS label, CAST(sum(p_size) AS BIGINT) AS bases FROM part GROUP BY 1")
def labels(spark, sf):
    return annotations.labels_of(table(spark, sf, "part"), "p_brand", "p_size").groupBy("label").agg(F.count("*").alias("bases"))


@query("s24_same_sequences", "SELECT bool_and(n_name = upper(n_name)) AS identical FROM nation")
def same_sequences(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return annotations.same_sequences(n, n.withColumn("n_name", F.upper("n_name")), "n_nationkey", "n_name")


@query(
    "a27_orf_totals",
    f"""
WITH d AS (SELECT doc_id, {_BASES} AS s FROM documents), a AS (SELECT doc_id, s, instr(s, 'ATG') AS b FROM d),
k AS (SELECT doc_id, min(i) AS i FROM a, unnest(generate_series(0, CAST(floor((length(s) - b + 1) / 3) AS BIGINT) - 1)) u(i) WHERE b > 0 AND substr(s, CAST(b + i * 3 AS BIGINT), 3) IN ('TAA', 'TAG', 'TGA') GROUP BY 1)
SELECT count(*) AS orfs, CAST(sum(i * 3) AS BIGINT) AS bases, CAST(max(i * 3) AS INT) AS longest FROM k
""",
)
def orf_totals(spark, sf):
    # no filter: it would be pushed down and find every frame twice
    o = table(spark, sf, "documents").select(sq.first_orf(F.expr(_BASES)).alias("o"))
    length = F.when(F.col("o.stop") >= 0, F.col("o.stop") - F.col("o.start"))
    return o.select(length.alias("n")).agg(F.count("n").alias("orfs"), F.sum("n").alias("bases"), F.max("n").alias("longest"))


_PAIRS = "WITH p AS (SELECT p_partkey, substr(p_name, 1, 8) AS s FROM part), x AS (SELECT p_partkey, CAST(i - 1 AS INT) AS pos, CASE WHEN i > 1 THEN substr(s, CAST(i - 1 AS INT), 1) ELSE '' END AS before, substr(s, CAST(i AS INT), 1) AS c FROM p, unnest(generate_series(1, length(s))) u(i))"
_ARRAY = "m AS (SELECT pos, before, c, ln((n + 1.0) / (sum(n) OVER (PARTITION BY pos, before) + count(*) OVER (PARTITION BY pos, before))) AS logp FROM k)"


@query("m03_weight_array", f"{_PAIRS}, k AS (SELECT pos, before, c, count(*) AS n FROM x GROUP BY ALL), {_ARRAY} SELECT p_partkey, round(sum(logp), 6) AS score FROM x JOIN m USING (pos, before, c) GROUP BY 1")
def weight_array(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    model = models.weight_array(p, F.col("p_name"), 8)
    return models.weight_array_score(p, "p_partkey", F.col("p_name"), 8, model).select("p_partkey", F.round("score", 6).alias("score"))


@query(
    "m04_windowed_array",
    f"{_PAIRS}, w AS (SELECT pos, before, c FROM x WHERE pos = 0 UNION ALL SELECT pos + d, before, c FROM x, (VALUES (-2), (-1), (0), (1), (2)) v(d) WHERE pos > 0 AND pos + d > 0 AND pos + d < 8), k AS (SELECT pos, before, c, count(*) AS n FROM w GROUP BY ALL), {_ARRAY} SELECT p_partkey, round(sum(logp), 6) AS score FROM x JOIN m USING (pos, before, c) GROUP BY 1",
)
def windowed_array(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    model = models.weight_array(p, F.col("p_name"), 8, pooled=2)
    return models.weight_array_score(p, "p_partkey", F.col("p_name"), 8, model).select("p_partkey", F.round("score", 6).alias("score"))


@query(
    "m13_periodic_chain",
    """
WITH k AS (SELECT CAST(i % 3 AS INT) AS phase, substr(p_name, CAST(i AS INT), 1) AS before, substr(p_name, CAST(i + 1 AS INT), 1) AS c, count(*) AS n FROM part, unnest(generate_series(1, length(p_name) - 1)) u(i) GROUP BY ALL)
SELECT phase, before, c, round(ln(n / CAST(sum(n) OVER (PARTITION BY phase, before) AS DOUBLE)), 6) AS logp FROM k
""",
)
def periodic_chain(spark, sf):
    return models.periodic_chain(table(spark, sf, "part"), F.col("p_name")).select("phase", "before", "c", F.round("logp", 6).alias("logp"))


@query("j01_haplotype_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def haplotype_join(spark, sf):
    o, c = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("gene")), table(spark, sf, "customer").select(F.col("c_custkey").alias("gene"), "c_name")
    return o.join(c, "gene").select("o_orderkey", "c_name")


@query("j18_substrate_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def substrate_join(spark, sf):
    s, n = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return s.join(n, "k").select("s_suppkey", "n_name")


@query("o06_first_genes", "SELECT p_partkey, p_name FROM part ORDER BY p_brand, p_partkey LIMIT 50")
def first_genes(spark, sf):
    return table(spark, sf, "part").orderBy("p_brand", "p_partkey").limit(50).select("p_partkey", "p_name")
