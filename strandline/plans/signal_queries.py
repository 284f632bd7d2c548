"""Sensor scans, start codons, new sites, variant classes and RNA evidence over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import annotations, intervals, models, signals, splicing, variants
from .registry import query, table
from .sequence_queries import _DNA, _dna

_D = f"d AS (SELECT p_partkey, {_DNA} AS dna FROM part)"


def _matrix_sql(name: str, width: int) -> str:
    """The weight matrix of the first `width` bases, as a table (pos, c, lp)."""
    return f"""{name} AS (SELECT g.pos, g.c, ln((coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY g.pos)) AS lp
FROM (SELECT pos, c FROM unnest(generate_series(0, {width - 1})) u(pos), (VALUES ('A'), ('C'), ('G'), ('T')) v(c)) g
LEFT JOIN (SELECT i AS pos, substr(dna, CAST(i + 1 AS INT), 1) AS c, count(*) AS n FROM d, unnest(generate_series(0, {width - 1})) u(i) GROUP BY ALL) k USING (pos, c))"""


def _score_sql(window: str, matrix: str) -> str:
    return f"(SELECT CASE WHEN count(lp) = length({window}) THEN sum(lp) END FROM {matrix} WHERE substr({window}, CAST({matrix}.pos + 1 AS INT), 1) = {matrix}.c)"


def _matrix(dna, width: int):
    return models.matrix_map(models.train_weight_matrix(dna, F.col("dna"), width, "ACGT"))


_SCAN = f"""WITH {_D}, {_matrix_sql("m", 6)},
w AS (SELECT p_partkey, CAST(i AS INT) AS pos, substr(dna, CAST(i + 1 AS INT), 6) AS w FROM d, unnest(generate_series(0, length(dna) - 6)) u(i)),
s AS (SELECT p_partkey, pos, '+' AS strand, w FROM w UNION ALL SELECT p_partkey, pos, '-', reverse(translate(w, 'ACGT', 'TGCA')) FROM w),
k AS (SELECT w, sum(lp) AS score FROM (SELECT DISTINCT w FROM s) x JOIN m ON substr(w, CAST(m.pos + 1 AS INT), 1) = m.c GROUP BY 1),
z AS (SELECT p_partkey, pos, strand, score FROM s JOIN k USING (w))"""


@query("m16_scan", f"{_SCAN} SELECT p_partkey, pos, strand, round(score, 6) AS score FROM z WHERE score >= -7.2345")
def scan(spark, sf):
    dna = _dna(spark, sf)
    return signals.scan(dna, "p_partkey", "dna", _matrix(dna, 6), 6, -7.2345).withColumn("score", F.round("score", 6))


@query(
    "m16_cutoff",
    f"""{_SCAN}, c AS (SELECT round(score, 9) AS s, count(*) AS n FROM z GROUP BY 1),
r AS (SELECT s, n, sum(n) OVER (ORDER BY s DESC) AS upto, lead(s) OVER (ORDER BY s DESC) AS below, lag(s) OVER (ORDER BY s DESC) AS above FROM c)
SELECT round(CASE WHEN upto > 500 AND 500 - (upto - n) < upto - 501 THEN coalesce((s + above) / 2, 0) ELSE (s + below) / 2 END, 6) AS cutoff FROM r WHERE upto >= 500 AND upto - n < 500""",
)
def scan_cutoff(spark, sf):
    dna = _dna(spark, sf)
    found = signals.scan(dna, "p_partkey", "dna", _matrix(dna, 6), 6).withColumn("score", F.round("score", 9))
    return signals.cutoff_for(found, "score", 500).select(F.round("cutoff", 6).alias("cutoff"))


_SITE = signals.Sensor(width=6, offset=2, consensus=("GT", "GC", "AG"), cutoff=-9.1234)


@query(
    "p14_de_novo_sites",
    f"""WITH {_D}, {_matrix_sql("m", 6)}, a AS (SELECT p_partkey, dna, concat(substr(dna, 1, 5), 'G', substr(dna, 7)) AS alt FROM d),
w AS (SELECT p_partkey, i, substr(alt, CAST(i + 1 AS INT), 6) AS w, substr(dna, CAST(i + 1 AS INT), 6) AS v FROM a, unnest(generate_series(0, 5)) u(i) WHERE i + 6 <= length(alt)),
s AS (SELECT p_partkey, i, {_score_sql("w", "m")} AS score, CASE WHEN substr(v, 3, 2) IN ('GT', 'GC', 'AG') THEN {_score_sql("v", "m")} END AS was FROM w WHERE substr(w, 3, 2) IN ('GT', 'GC', 'AG'))
SELECT p_partkey, CAST(i + 2 AS INT) AS pos, round(score, 6) AS score FROM s WHERE score >= -9.1234 + ln(2) AND (was IS NULL OR (was < -9.1234 AND score - was >= ln(2)))""",
)
def de_novo_sites(spark, sf):
    dna = _dna(spark, sf)
    changed = dna.withColumn("alt", F.overlay("dna", F.lit("G"), 6, 1)).withColumn("cigar", F.concat(F.length("dna").cast("string"), F.lit("M")))
    changed = changed.withColumn("v", F.array(F.struct(F.lit(5).alias("begin"), F.lit(6).alias("end"))))
    return signals.de_novo_sites(changed, "p_partkey", "dna", "alt", "cigar", "v", _matrix(dna, 6), _SITE).withColumn("score", F.round("score", 6))


_CRYPTIC = f"""WITH {_D}, {_matrix_sql("m", 6)},
w AS (SELECT p_partkey, p_size AS vertex, i, substr(dna, CAST(i + 1 AS INT), 6) AS w FROM d JOIN part USING (p_partkey), unnest(generate_series(0, 7)) u(i) WHERE i < length(dna) - 6 AND i + 2 <> 7),
c AS (SELECT p_partkey, vertex, CAST(i + 2 AS INT) AS pos, {_score_sql("w", "m")} AS score FROM w WHERE substr(w, 3, 2) IN ('GT', 'GC', 'AG'))"""


def _cryptic(spark, sf):
    dna = _dna(spark, sf)
    broken = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("vertex"), F.lit(7).alias("begin"), F.lit(9).alias("end"))
    return signals.cryptic_sites(broken, dna, "p_partkey", "dna", _matrix(dna, 6), _SITE, 3)


@query("p12_cryptic_sites", f"{_CRYPTIC} SELECT p_partkey, vertex, pos, round(score, 6) AS score FROM c WHERE score >= -9.1234 AND pos - 2 >= 2 AND pos - 2 < 8")
def cryptic_sites(spark, sf):
    return _cryptic(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "p12_inherited_edges",
    f"""{_CRYPTIC}, s AS (SELECT p_partkey, concat(vertex, '@', pos) AS site FROM c WHERE score >= -9.1234 AND pos - 2 >= 2 AND pos - 2 < 8)
SELECT p_partkey, p_brand AS src, site AS dst FROM s JOIN part USING (p_partkey) UNION ALL SELECT p_partkey, site, p_type FROM s JOIN part USING (p_partkey)""",
)
def inherited_edges(spark, sf):
    p = table(spark, sf, "part")
    edges = p.select("p_partkey", F.col("p_brand").alias("src"), F.col("p_size").cast("string").alias("dst")).unionByName(p.select("p_partkey", F.col("p_size").cast("string").alias("src"), F.col("p_type").alias("dst")))
    return signals.inherited_edges(_cryptic(spark, sf), edges, "p_partkey")


@query(
    "p04_start_codon",
    f"""WITH {_D}, {_matrix_sql("m", 8)}, {_matrix_sql("k", 3)},
t AS (SELECT p_partkey, i, CASE WHEN i = 1 OR i < 3 THEN substr(dna, CAST(i + 1 AS INT), 3) END AS near, substr(dna, CAST(i - 2 AS INT), 8) AS far FROM d, unnest(generate_series(1, length(dna))) u(i) WHERE i - 3 + 8 < length(dna)),
s AS (SELECT p_partkey, i, CASE WHEN near IS NOT NULL THEN {_score_sql("near", "k")} ELSE {_score_sql("far", "m")} END AS score FROM t),
h AS (SELECT p_partkey, min(i) AS i FROM s WHERE score >= -9.8765 GROUP BY 1)
SELECT p_partkey, CAST(coalesce(i, -1) AS INT) AS start FROM d LEFT JOIN h USING (p_partkey)""",
)
def start_codon(spark, sf):
    dna = _dna(spark, sf)
    sensor = signals.Sensor(width=8, offset=3, consensus=("ATG",), cutoff=-9.8765)
    return signals.start_codons(dna.withColumn("from", F.lit(1)), "p_partkey", "dna", "from", _matrix(dna, 8), sensor, _matrix(dna, 3), 3)


@query(
    "p01_well_formed",
    f"""WITH {_D}, p AS (SELECT p_partkey, dna, concat(substr(dna, 1, 9), substr(dna, 13)) AS s, concat(substr(dna, 1, 9), substr(dna, 13)) AS t FROM d),
c AS (SELECT *, list_transform(generate_series(0, length(s) // 3 - 1), lambda i: substr(s, CAST(i * 3 + 1 AS INT), 3)) AS k FROM p),
x AS (SELECT *, len(k) AS n, least(nullif(list_position(k, 'TAA'), 0), nullif(list_position(k, 'TAG'), 0), nullif(list_position(k, 'TGA'), 0)) AS stop FROM c),
f AS (SELECT p_partkey, n < 1 OR k[1] <> 'ATG' AS no_start, coalesce(stop < n, false) AS ptc, n < 1 OR stop IS NULL AS no_stop, substr(dna, 10, 2) NOT IN ('GT', 'GC') OR substr(dna, 11, 2) NOT IN ('AG') AS bad FROM x)
SELECT p_partkey, no_start, no_stop AND NOT ptc AS no_stop, ptc, bad AS bad_splice, NOT (no_start OR no_stop OR ptc OR bad) AS ok FROM f""",
)
def well_formed(spark, sf):
    exon = lambda b, e: F.struct(F.lit(b).alias("begin"), e.alias("end"))
    d = _dna(spark, sf).withColumn("x", F.array(exon(0, F.lit(9)), exon(12, F.length("dna"))))
    flags = signals.well_formed(F.col("dna"), F.col("x"), F.lit(False), ("GT", "GC"), ("AG",))
    return d.select("p_partkey", F.inline(F.array(flags)))


_EXONS = "e AS (SELECT l_orderkey AS t, l_linenumber * 100 AS b, CAST(l_linenumber * 100 + max(l_quantity) AS BIGINT) AS e, CASE WHEN max(l_linestatus) = 'O' THEN 'UTR' ELSE 'CDS' END AS kind FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(
    "p09_variant_classes",
    f"""WITH {_EXONS}, x AS (SELECT *, row_number() OVER w > 1 AS acceptor, lead(b) OVER w AS nx FROM e WINDOW w AS (PARTITION BY t ORDER BY b, e)),
r AS (SELECT t, min(b) AS tb, max(e) AS te FROM e GROUP BY 1),
v AS (SELECT o_orderkey AS t, 100 + o_custkey % 250 AS p, 100 + o_custkey % 250 + length(o_orderpriority) % 3 + 1 AS q, length(o_orderpriority) % 3 AS change FROM orders),
y AS (SELECT * FROM v JOIN r USING (t)),
c AS (SELECT y.t, kind AS element, CASE WHEN kind = 'CDS' THEN least(CASE WHEN nx IS NOT NULL THEN least(abs(p - e), abs(q - e)) END, CASE WHEN acceptor THEN least(abs(p - b), q - b) END) END AS distance, kind = 'CDS' AND change % 3 <> 0 AS frameshift FROM y JOIN x USING (t) WHERE p >= tb AND p < te AND p < e AND b < q
UNION ALL SELECT y.t, CASE WHEN p < e + 2 OR q > nx - 2 THEN 'SPLICE_SITE' ELSE 'INTRON' END, NULL, false FROM y JOIN x USING (t) WHERE nx > e AND p >= tb AND p < te AND p < nx AND e < q
UNION ALL SELECT t, 'INTERGENIC', NULL, false FROM y WHERE p < tb OR p >= te)
SELECT t, element, CAST(distance AS BIGINT) AS distance, coalesce(distance BETWEEN 0 AND 3, false) AS near_splice, frameshift FROM c""",
)
def variant_classes(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_linestatus").alias("s"))
    exons = l.select(F.col("l_orderkey").alias("t"), F.when(F.col("s") == "O", "UTR").otherwise("CDS").alias("kind"), (F.col("l_linenumber") * 100).alias("begin"), (F.col("l_linenumber") * 100 + F.col("q")).cast("long").alias("end"))
    change = F.length("o_orderpriority") % 3
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_orderkey").alias("id"), (100 + F.col("o_custkey") % 250).alias("pos"), F.repeat(F.lit("A"), change + 1).alias("ref"), F.lit("G").alias("alt"))
    return signals.classify_variants(v, exons, "t", "id").drop("id")


@query(
    "p23_supported_exons",
    """WITH k AS (SELECT p_brand, p_size AS pos, count(*) AS n FROM part GROUP BY ALL), x AS (SELECT p_partkey, p_brand, p_size AS b, p_size + 1 + length(p_type) % 3 AS e FROM part)
SELECT p_partkey FROM x JOIN k USING (p_brand) WHERE k.pos >= b AND k.pos < e AND n >= 2 GROUP BY p_partkey, b, e HAVING count(*) = e - b""",
)
def supported_exons(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    cover = p.groupBy("p_brand", F.col("p_size").alias("pos")).agg(F.count("*").alias("depth"))
    exons = p.select("p_partkey", "p_brand", F.col("p_size").alias("begin"), (F.col("p_size") + 1 + F.length("p_type") % 3).alias("end"))
    return signals.supported_exons(exons, cover, "p_brand", 2).select("p_partkey")


@query("p23_supported_introns", "SELECT p_partkey FROM part JOIN (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 40) j ON p_size = l_quantity AND l_returnflag = 'A'")
def supported_introns(spark, sf):
    ends = lambda c: (F.col(c).cast("long").alias("begin"), (F.col(c) + 10).cast("long").alias("end"))
    junctions = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("s"), *ends("l_quantity")).agg(F.count("*").alias("depth"))
    return signals.supported_introns(table(spark, sf, "part").select("p_partkey", F.lit("A").alias("s"), *ends("p_size")), junctions, "s", 40).select("p_partkey")


@query(
    "p22_reweight",
    """
WITH n AS (SELECT l_returnflag AS s, CAST(l_quantity AS BIGINT) AS pos, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT s, pos, coalesce(n, 0) / (coalesce(n, 0) + 100.0) AS share FROM (SELECT s, pos FROM (SELECT DISTINCT s FROM n) a, unnest(generate_series(0, 99)) u(pos)) g LEFT JOIN n USING (s, pos)),
j AS (SELECT l_returnflag AS s, CAST(l_linenumber AS BIGINT) AS b, CAST(l_linenumber + l_linenumber % 3 + 5 AS BIGINT) AS e, count(*) AS depth FROM lineitem GROUP BY ALL),
m AS (SELECT s, max(depth) AS most FROM j GROUP BY 1),
e AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'N' ELSE 'R' END AS s, CASE WHEN o_orderpriority < '3' THEN 'intron' WHEN o_orderpriority < '4' THEN 'exon' ELSE 'intergenic' END AS kind, CAST(o_custkey % 20 AS BIGINT) AS b, CAST(o_custkey % 20 + 5 + length(o_orderpriority) % 3 AS BIGINT) AS e, o_totalprice / 100000 AS score FROM orders),
r AS (SELECT o_orderkey, sum(ln(share + 1e-8)) AS on_, sum(ln(1 - share + 1e-8)) AS off_ FROM e JOIN c USING (s) WHERE c.pos >= e.b AND c.pos < e.e GROUP BY 1)
SELECT e.o_orderkey AS edge, round(0.5 * e.score + 2 * CASE e.kind WHEN 'intron' THEN ln((coalesce(j.depth, 0) + 1.0) / coalesce(m.most, 1)) * (e.e - e.b) WHEN 'exon' THEN on_ ELSE off_ END, 6) AS score, e.kind = 'intron' AND coalesce(j.depth, 0) > 0 AS support
FROM e JOIN r USING (o_orderkey) LEFT JOIN j ON j.s = e.s AND j.b = e.b AND j.e = e.e LEFT JOIN m ON m.s = e.s
""",
)
def reweight(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("s"), F.col("l_quantity").cast("long").alias("pos"), F.col("l_linenumber").cast("long").alias("b"))
    n = l.groupBy("s", "pos").agg(F.count("*").alias("n"))
    share = F.coalesce("n", F.lit(0)) / (F.coalesce("n", F.lit(0)) + 100.0)
    cover = l.select("s").distinct().select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("pos")).join(n, ["s", "pos"], "left").select("s", "pos", share.alias("share"))
    junctions = l.groupBy("s", F.col("b").alias("begin"), (F.col("b") + F.col("b") % 3 + 5).alias("end")).agg(F.count("*").alias("depth"))
    b = (F.col("o_custkey") % 20).cast("long")
    edges = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R").alias("s"),
        F.col("o_orderkey").alias("edge"),
        F.when(F.col("o_orderpriority") < "3", "intron").when(F.col("o_orderpriority") < "4", "exon").otherwise("intergenic").alias("kind"),
        b.alias("begin"),
        (b + 5 + F.length("o_orderpriority") % 3).alias("end"),
        (F.col("o_totalprice") / 100000).alias("score"),
    )
    return signals.reweight(edges, cover, junctions, "s", 0.5, 2.0).select("edge", F.round("score", 6).alias("score"), "support")


@query(
    "j15_mapped_labels",
    """
WITH l AS (SELECT p_partkey, label, b + length(p_type) % 3 AS b, e + length(p_type) % 3 AS e FROM part, (VALUES ('exon', 0, 4), ('intron', 4, 9), ('exon', 9, 18)) v(label, b, e)), s AS (SELECT * FROM (VALUES (0, 0, 3), (3, 5, 5), (9, 10, 9)) v(r, a, n))
SELECT p_partkey, label, CAST(greatest(b, r) + a - r AS BIGINT) AS "begin", CAST(least(e, r + n) + a - r AS BIGINT) AS "end" FROM l JOIN s ON b < r + n AND r < e
""",
)
def mapped_labels(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.length("p_type") % 3).alias("k"))
    runs = F.array(*[F.struct(F.lit(x).alias("label"), (F.col("k") + b).cast("long").alias("begin"), (F.col("k") + e).cast("long").alias("end")) for x, b, e in (("exon", 0, 4), ("intron", 4, 9), ("exon", 9, 18))])
    matched = F.filter(sq.cigar_segments(F.lit("3M2I5M1D9M")), lambda s: s["op"] == "M")
    return signals.mapped_labels(p.select("p_partkey", F.inline(runs)), p.select("p_partkey", F.inline(matched)), "p_partkey")


@query(
    "m12_interpolated",
    f"""
WITH {_D}, a AS (SELECT * FROM (VALUES ('A'), ('C'), ('G'), ('T')) v(c)),
g1 AS (SELECT substr(dna, CAST(i AS INT), 1) AS c, count(*) + 1 AS n FROM d, unnest(generate_series(1, length(dna))) u(i) GROUP BY 1),
g2 AS (SELECT x.c AS h, y.c, coalesce(n, 0) + 1 AS n FROM a x CROSS JOIN a y LEFT JOIN (SELECT substr(dna, CAST(i AS INT), 1) AS h, substr(dna, CAST(i + 1 AS INT), 1) AS c, count(*) AS n FROM d, unnest(generate_series(1, length(dna) - 1)) u(i) GROUP BY ALL) k ON k.h = x.c AND k.c = y.c),
p1 AS (SELECT c, n AS m, sum(n) OVER () AS total, ln(n / CAST(sum(n) OVER () AS DOUBLE)) AS before FROM g1),
x AS (SELECT h, g2.c, n, sum(n) OVER (PARTITION BY h) AS alln, ln(n / CAST(sum(n) OVER (PARTITION BY h) AS DOUBLE)) AS own, before, m / CAST(total AS DOUBLE) AS q FROM g2 JOIN p1 USING (c)),
f AS (SELECT *, floor(q * alln + 0.5) AS e FROM x), f2 AS (SELECT *, sum((n - e) * (n - e) / nullif(e, 0)) OVER (PARTITION BY h) AS chi FROM f),
w AS (SELECT *, CASE WHEN chi > 120 THEN 1.0 ELSE (SELECT 2 / sqrt(pi()) * exp(-chi / 2) * sqrt(chi / 2) * (sum(exp(k * ln(chi) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())))) - 1) FROM unnest(generate_series(0, 300)) u(k)) END AS sure FROM f2),
o AS (SELECT h, c, CASE WHEN alln >= 400 THEN 1.0 WHEN sure < 0.5 THEN 0.0 ELSE sure * alln / 400 END AS l, own, before FROM w)
SELECT h AS history, c, round(l * own + (1 - l) * before, 6) AS logp FROM o UNION ALL SELECT '', c, round(before, 6) FROM p1
""",
)
def interpolated(spark, sf):
    return models.interpolated_model(_dna(spark, sf), F.col("dna"), 1, "ACGT").withColumn("logp", F.round("logp", 6))


@query(
    "s04_flanking_signals",
    f"""WITH {_EXONS}, x AS (SELECT t, b, e, t % 2 = 0 AS fw, row_number() OVER (PARTITION BY t ORDER BY b, e) AS i, count(*) OVER (PARTITION BY t) AS n FROM e),
k AS (SELECT *, n = 1 OR i = 1 AS starts, n = 1 OR i = n AS stops FROM x),
l AS (SELECT t, CASE WHEN fw THEN CASE WHEN starts THEN 'ATG' ELSE 'AG' END ELSE CASE WHEN stops THEN 'NEG_TAG' ELSE 'NEG_GT' END END AS signal, b, e, true AS l FROM k
UNION ALL SELECT t, CASE WHEN fw THEN CASE WHEN stops THEN 'TAG' ELSE 'GT' END ELSE CASE WHEN starts THEN 'NEG_ATG' ELSE 'NEG_AG' END END, b, e, false FROM k),
p AS (SELECT t, signal, CAST(CASE WHEN l THEN b - CASE WHEN signal IN ('AG', 'NEG_GT') THEN 2 ELSE 0 END ELSE e - CASE WHEN signal IN ('TAG', 'NEG_ATG') THEN 3 ELSE 0 END END AS BIGINT) AS pos FROM l)
SELECT t, signal, pos, pos - CASE signal WHEN 'GT' THEN 4 WHEN 'AG' THEN 20 ELSE 0 END AS "window" FROM p""",
)
def flanking_signals(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    begin = (F.col("l_linenumber") * 100).cast("long")
    kinds = annotations.tile(l.select(F.col("l_orderkey").alias("t"), begin.alias("b"), (begin + F.col("q")).cast("long").alias("e")), "t", "b", "e")
    return annotations.flanking_signals(kinds.withColumn("strand", F.when(F.col("t") % 2 == 0, "+").otherwise("-")), ["t"], "kind", "begin", "end", "strand", {"GT": 4, "AG": 20})


@query(
    "m06_branch_acceptor",
    f"WITH {_D}, {_matrix_sql('m', 4)}, {_matrix_sql('k', 5)}, w AS (SELECT p_partkey, substr(dna, 1, 4) AS x, substr(dna, 5, 5) AS y FROM d) SELECT p_partkey, round({_score_sql('x', 'm')} + {_score_sql('y', 'k')}, 6) AS score FROM w WHERE length(y) = 5",
)
def branch_acceptor(spark, sf):
    dna = _dna(spark, sf)
    both = dna.filter("length(dna) >= 9").crossJoin(F.broadcast(_matrix(dna, 4).withColumnRenamed("matrix", "a"))).crossJoin(F.broadcast(_matrix(dna, 5).withColumnRenamed("matrix", "b")))  # one row each
    return both.select("p_partkey", F.round(signals.composite_score(F.col("dna"), F.col("a"), 4, F.col("b"), 5), 6).alias("score"))


@query("r06_symbol_split", f"WITH {_D} SELECT p_partkey, CASE WHEN substr(dna, 4, 1) IN ('A', 'G') THEN 'left' ELSE 'right' END AS side FROM d")
def symbol_split(spark, sf):
    return signals.split_by_symbols(_dna(spark, sf), "dna", 3, "AG").select("p_partkey", "side")


@query("s19_graph", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def graph(spark, sf):
    """A graph of orders, customers and nations, stored and read back; paths of two edges by their vertices' names."""
    from .source_queries import _path

    path = _path(spark, "graph")
    c, n, o = (table(spark, sf, t) for t in ("customer", "nation", "orders"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    vertices = c.select(name("c", "c_custkey").alias("vertex"), F.col("c_name").alias("label")).unionByName(n.select(name("n", "n_nationkey").alias("vertex"), F.col("n_name").alias("label")))
    edges = o.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst")).unionByName(c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")))
    splicing.write_graph(vertices, edges, path)
    v, e = splicing.read_graph(spark, path)
    first, second = e.select("src", F.col("dst").alias("via")), e.select(F.col("src").alias("via"), "dst")
    label = lambda k, a: v.select(F.col("vertex").alias(k), F.col("label").alias(a))
    walked = first.join(second, "via").filter(F.startswith("src", F.lit("o"))).join(label("via", "c_name"), "via").join(label("dst", "n_name"), "dst")
    return walked.select(F.substring("src", 2, 30).cast("long").alias("o_orderkey"), "c_name", "n_name")


@query(
    "j07_segment_mask",
    """
WITH f AS (SELECT p_brand AS s, p_partkey % 97 * 10 AS b, p_partkey % 97 * 10 + p_size AS e FROM part UNION ALL SELECT concat('Brand#', c_nationkey), c_custkey % 997, c_custkey % 997 + 1 FROM customer),
o AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY s ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM f),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY s ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT s, CAST(min(b) AS BIGINT) AS "begin", CAST(max(e) AS BIGINT) AS "end", count(*) AS members FROM g GROUP BY s, k
""",
)
def segment_mask(spark, sf):
    """What features and variants of a sequence cover together."""
    at = F.col("p_partkey") % 97 * 10
    features = table(spark, sf, "part").select(F.col("p_brand").alias("s"), at.alias("b"), (at + F.col("p_size")).alias("e"))
    spots = table(spark, sf, "customer").select(F.concat(F.lit("Brand#"), "c_nationkey").alias("s"), (F.col("c_custkey") % 997).alias("b"), (F.col("c_custkey") % 997 + 1).alias("e"))
    return intervals.islands(features.unionByName(spots), ["s"], "b", "e", "b").select("s", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "members")


@query(
    "g04_major_genomes",
    """
WITH c AS (SELECT l_linenumber * 5 AS pos, l_returnflag AS population, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY ALL),
p AS (SELECT DISTINCT population FROM c)
SELECT p.population, string_agg(CASE WHEN 2 * f > n THEN 'GG' ELSE 'A' END, '' ORDER BY i) AS hap_seq, CAST(count(*) FILTER (2 * f > n) AS INT) AS applied FROM p CROSS JOIN unnest(generate_series(0, 59)) u(i) LEFT JOIN c ON c.population = p.population AND c.pos = i GROUP BY 1
""",
)
def major_genomes(spark, sf):
    l = table(spark, sf, "lineitem")
    letters = F.array(F.lit("A"), F.lit("GG"))
    g = l.select(F.lit("chr1").alias("chr"), (F.col("l_linenumber") * 5).cast("int").alias("ref_pos"), F.col("l_linenumber").cast("string").alias("id"), letters.alias("alleles"), F.col("l_returnflag").alias("sample"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("allele"))
    people = l.select(F.col("l_returnflag").alias("sample"), F.col("l_returnflag").alias("population")).distinct()
    regions = spark.range(1).select(F.lit("chr1").alias("chr"), F.lit("A" * 60).alias("seq"))
    return variants.major_genomes(regions, g, people).select("population", "hap_seq", "applied")
