"""Sources and sinks: star-schema rows written in each format to the shared folder and read back, and variants on them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import reports, variants
from ..sources import genomic
from ..sources.tables import scratch
from .registry import query, table
from .sequence_queries import _DNA, _dna


def _path(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("s02_fasta", f"WITH d AS (SELECT p_partkey, p_brand, repeat({_DNA}, 12) AS seq FROM part) SELECT concat('part', p_partkey) AS id, p_brand AS brand, seq, length(seq) AS n FROM d")
def fasta(spark, sf):
    path = _path(spark, "fasta")
    p = table(spark, sf, "part").select(F.concat(F.lit("part"), "p_partkey").alias("id"), F.create_map(F.lit("brand"), "p_brand").alias("attrs"), F.repeat(F.expr(_DNA), F.lit(12)).alias("seq"))
    genomic.write_fasta(p, path)
    back = genomic.read_fasta(spark, path)
    return back.select("id", F.col("attrs")["brand"].alias("brand"), "seq", F.length("seq").alias("n"))


_FEATURES = "SELECT l_orderkey, l_linenumber, CASE WHEN max(l_returnflag) = 'N' THEN 'CDS' ELSE 'exon' END AS feature, l_linenumber * 100 AS b, CAST(l_linenumber * 100 + max(l_quantity) AS BIGINT) AS e FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _features(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    begin = (F.col("l_linenumber") * 100).cast("int")
    return l.select(
        F.lit("chr1").alias("substrate"), F.lit("lines").alias("source"), F.when(F.col("f") == "N", "CDS").otherwise("exon").alias("feature"), begin.alias("begin"), (begin + F.col("q")).cast("int").alias("end"),
        F.lit(None).cast("string").alias("score"), F.lit("+").alias("strand"), F.lit(None).cast("string").alias("phase"),
        F.concat(F.lit("g"), (F.col("l_orderkey") % 1000).cast("string")).alias("gene_id"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("transcript_id"),
    )


def _gff(spark, sf):
    path = _path(spark, "gff")
    genomic.write_gff(_features(spark, sf), path)
    return genomic.read_gff(spark, path)


@query("s03_gff_transcripts", f"""SELECT concat('t', l_orderkey) AS transcript_id, count(*) AS parts, CAST(sum(e - b) AS BIGINT) AS length, CAST(min(b) AS INT) AS "begin", CAST(max(e) AS INT) AS "end" FROM ({_FEATURES}) x GROUP BY 1""")
def gff_transcripts(spark, sf):
    t = genomic.transcripts(_gff(spark, sf))
    return t.select("transcript_id", F.size("exons").cast("long").alias("parts"), F.col("length").cast("long").alias("length"), F.get("exons", F.lit(0))["begin"].alias("begin"), F.array_max(F.transform("exons", lambda e: e["end"])).alias("end"))


@query("s08_bed", f"""SELECT concat('g', l_orderkey % 1000) AS name, CAST(min(b) AS INT) AS "begin", CAST(max(e) AS INT) AS "end" FROM ({_FEATURES}) x GROUP BY 1""")
def bed(spark, sf):
    """Gene extents of a GFF as BED, written and read back."""
    path = _path(spark, "bed")
    genomic.write_bed(genomic.gene_extents(_gff(spark, sf)).select("substrate", "begin", "end", "gene_id"), path)
    return genomic.read_bed(spark, path).select("name", "begin", "end")


@query("s05_gff3_to_gtf", """SELECT concat('t', c_custkey) AS transcript_id, concat('g', c_nationkey) AS gene_id, 'mRNA' AS feature FROM customer UNION ALL SELECT concat('t', o_custkey), concat('t', o_custkey), 'exon' FROM orders""")
def gff3_to_gtf(spark, sf):
    """GFF3 with ID and Parent, rewritten as GTF and read back; an exon's Parent names its transcript."""
    gff3, gtf = _path(spark, "gff3"), _path(spark, "gtf")
    row = lambda feature, extra: [F.lit("chr1"), F.lit("x"), F.lit(feature), F.lit(1), F.lit(9), F.lit("."), F.lit("+"), F.lit("."), extra]
    genes = table(spark, sf, "customer").select(*row("mRNA", F.concat(F.lit("ID=t"), "c_custkey", F.lit(";Parent=g"), "c_nationkey")))
    exons = table(spark, sf, "orders").select(*row("exon", F.concat(F.lit("ID=e"), "o_orderkey", F.lit(";Parent=t"), "o_custkey")))
    genes.union(exons).write.csv(gff3, sep="\t", quote="", escape="")
    genomic.write_gff(genomic.read_gff(spark, gff3, gff3=True), gtf)
    return genomic.read_gff(spark, gtf).select("transcript_id", "gene_id", "feature")


_SITES = """s AS (SELECT replace(p_brand, 'Brand#', 'chr') AS chr, p_partkey AS pos, concat('rs', p_partkey) AS id, p_size AS z, p_type = 'PROMO' AS low,
CASE WHEN p_size % 5 = 0 THEN ['A', 'G', 'T'] WHEN p_size % 11 = 0 THEN ['A', '<DEL>'] ELSE ['A', 'C'] END AS alleles FROM part)"""


def _vcf(spark, sf):
    path = _path(spark, "vcf")
    z = F.col("p_size")
    call = lambda s, gt: F.struct(F.lit(s).alias("sample"), gt.alias("gt"))
    letters = lambda *a: F.array(*[F.lit(x) for x in a])
    rows = table(spark, sf, "part").select(
        F.regexp_replace("p_brand", "Brand#", "chr").alias("chr"), F.col("p_partkey").alias("ref_pos"), F.concat(F.lit("rs"), "p_partkey").alias("id"),
        F.when(z % 5 == 0, letters("A", "G", "T")).when(z % 11 == 0, letters("A", "<DEL>")).otherwise(letters("A", "C")).alias("alleles"),
        F.when(F.col("p_type") == "PROMO", "q10").otherwise("PASS").alias("filter"), F.lit("GT").alias("format"),
        F.array(call("s0", F.when(z % 2 == 0, "0|1").otherwise("1|1")), call("s1", F.when(z % 7 == 0, ".|.").otherwise("0|0"))).alias("genotypes"),
    )
    genomic.write_vcf(rows, path, ["s0", "s1"])
    return genomic.read_vcf(spark, path)


@query(
    "s10_vcf",
    f"""WITH {_SITES} SELECT chr, CAST(pos AS INT) AS ref_pos, id, 's0' AS sample, hap, CASE WHEN hap = 0 AND z % 2 = 0 THEN 0 ELSE 1 END AS allele FROM s, (VALUES (0), (1)) v(hap)
UNION ALL SELECT chr, CAST(pos AS INT), id, 's1', hap, CASE WHEN z % 7 <> 0 THEN 0 END FROM s, (VALUES (0), (1)) v(hap)""",
)
def vcf(spark, sf):
    return variants.long_genotypes(_vcf(spark, sf)).drop("alleles")


@query("f02_strict_sites", f"WITH {_SITES} SELECT id, NOT (low OR z % 5 <> 0 AND z % 11 = 0) AS usable, NOT low AND z % 5 <> 0 AND z % 11 <> 0 AS strict, z % 5 = 0 OR z % 11 <> 0 AS dna FROM s")
def strict_sites(spark, sf):
    site = lambda strict: variants.usable_site(F.col("alleles"), F.col("filter"), F.col("format"), strict)
    return _vcf(spark, sf).select("id", site(False).alias("usable"), site(True).alias("strict"), variants.is_dna(F.col("alleles")).alias("dna"))


@query("s22_fastq", f"WITH d AS (SELECT p_partkey, p_size, {_DNA} AS seq FROM part) SELECT concat('r', p_partkey) AS id, seq, repeat('I', length(seq)) AS qual, p_size <= 40 AS paired FROM d")
def fastq(spark, sf):
    """Reads written and read back, with whether each has a mate."""
    dna = _dna(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    reads = dna.select(F.concat(F.lit("r"), "p_partkey").alias("id"), F.col("dna").alias("seq"), F.repeat(F.lit("I"), F.length("dna")).alias("qual"), "p_size")
    first, second = _path(spark, "fastq"), _path(spark, "fastq")
    genomic.write_fastq(reads, first)
    genomic.write_fastq(reads.filter("p_size <= 40"), second)
    pairs, alone, _ = genomic.pair_reads(genomic.read_fastq(spark, first), genomic.read_fastq(spark, second))
    flag = lambda df, v: df.select("id", "seq", "qual", F.lit(v).alias("paired"))
    return flag(pairs, True).unionByName(flag(alone, False))


@query("s13_indexed_region", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 120000 AND o_totalprice < 180000")
def indexed_region(spark, sf):
    """Rows stored by sequence and bin; a region reads the folders of its bins alone."""
    path = _path(spark, "indexed")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("chr"), F.col("o_totalprice").alias("pos"))
    genomic.write_indexed(o, path, "chr", "pos", 50000)
    return genomic.read_indexed(spark, path, "F", 120000, 180000, 50000).select("o_orderkey")


@query("u01_concatenate", "SELECT 'orders' AS what, o_orderkey AS id, o_totalprice AS v FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer")
def concatenate(spark, sf):
    part = lambda t, i, v: table(spark, sf, t).select(F.lit(t).alias("what"), F.col(i).alias("id"), F.col(v).alias("v"))
    return part("orders", "o_orderkey", "o_totalprice").unionByName(part("customer", "c_custkey", "c_acctbal"))


def _mapped(p: str) -> str:
    """A position through 150M20I200M30D500M; in the deletion and beyond the end, the base before."""
    return f"CASE WHEN {p} < 150 THEN {p} WHEN {p} < 350 THEN {p} + 20 WHEN {p} < 380 THEN 369 WHEN {p} < 880 THEN {p} - 10 ELSE 869 END"


@query("g06_mapped_exons", f"""SELECT concat('t', l_orderkey) AS transcript_id, CAST({_mapped("(b - 2)")} + 2 AS INT) AS "begin", CAST({_mapped("e")} AS INT) AS "end" FROM ({_FEATURES}) x""")
def mapped_exons(spark, sf):
    t = genomic.transcripts(_features(spark, sf)).withColumn("cigar", F.lit("150M20I200M30D500M"))
    return variants.map_exons(t, "cigar").select("transcript_id", F.inline("mapped"))


@query(
    "g02_chosen_variants",
    """
WITH v AS (SELECT l_orderkey AS t, CAST(l_linenumber * 3 AS INT) AS pos, 1 + max(CAST(l_quantity AS INT)) % 5 AS r, 1 + min(CAST(l_quantity AS INT)) % 4 AS a FROM lineitem GROUP BY l_orderkey, l_linenumber),
i AS (SELECT *, CASE WHEN max(pos + r - 1) OVER (PARTITION BY t ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= pos THEN 0 ELSE 1 END AS fresh FROM v),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY t ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY t, island ORDER BY r DESC, a DESC, pos) AS n, count(*) OVER (PARTITION BY t, island) - 1 AS dropped FROM g)
SELECT t, pos, CAST(r AS INT) AS r, CAST(a AS INT) AS a, dropped FROM k WHERE n = 1
""",
)
def chosen_variants(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t"), (F.col("l_linenumber") * 3).cast("int").alias("ref_pos"), F.col("l_quantity").cast("int").alias("q"))
    v = l.groupBy("t", "ref_pos").agg((1 + F.max("q") % 5).alias("r"), (1 + F.min("q") % 4).alias("a"))
    edits = v.select("t", "ref_pos", F.repeat(F.lit("A"), F.col("r")).alias("ref"), F.repeat(F.lit("C"), F.col("a")).alias("alt"))
    return variants.chosen_variants(edits, ["t"]).select("t", F.col("ref_pos").alias("pos"), F.length("ref").alias("r"), F.length("alt").alias("a"), "dropped")


@query(
    "p06_coding_change",
    """
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE o_custkey % 7 END AS rs, CASE WHEN o_custkey % 4 = 0 THEN -1 ELSE 30 END AS re, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 2 END AS s, 20 + o_orderkey % 60 AS e FROM orders)
SELECT o_orderkey, CASE WHEN s < 0 THEN NULL WHEN rs < 0 THEN 'ref-no-start-codon' WHEN re >= 0 AND e - s >= 2 * (re - rs) THEN 'ref-ORF-too-short' WHEN re < 0 THEN 'possible-misannotation' END AS change FROM o
""",
)
def coding_change(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    change = sq.coding_change(F.when(c % 4 == 0, -1).otherwise(30), 20 + k % 60, F.when(c % 3 == 0, -1).otherwise(c % 7), F.when(k % 5 == 0, -1).otherwise(2))
    return table(spark, sf, "orders").select("o_orderkey", change.alias("change"))


@query("s03_gff_repeated_keys", """SELECT concat('t', p_partkey) AS transcript_id, p_brand AS first_tag, CASE WHEN p_size % 3 = 0 THEN [p_brand] ELSE [p_brand, p_type, 'basic'] END AS tags FROM part""")
def gff_repeated_keys(spark, sf):
    """Features with a repeated tag attribute, written and read back."""
    path = _path(spark, "gff")
    tag = lambda c: F.concat(F.lit(' tag "'), c, F.lit('";'))
    extra = F.concat(F.lit('gene_id "g"; transcript_id "t'), F.col("p_partkey").cast("string"), F.lit('";'), tag(F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(tag(F.col("p_type")), tag(F.lit("basic")))))
    fields = [F.lit("chr1"), F.lit("x"), F.lit("transcript"), F.lit(1), F.lit(9), F.lit("."), F.lit("+"), F.lit("."), extra]
    table(spark, sf, "part").select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return genomic.read_gff(spark, path).select("transcript_id", F.col("attrs")["tag"].alias("first_tag"), F.col("attr_lists")["tag"].alias("tags"))


@query("s09_vcf_two_files", "SELECT concat('rs', p_partkey) AS id, concat('x', p_size % 2) AS sample, concat(p_size % 3, '|', p_size % 2) AS gt FROM part UNION ALL SELECT concat('rs', p_partkey), concat('y', p_size % 2), '0|1' FROM part WHERE p_size % 2 = 1")
def vcf_two_files(spark, sf):
    """Two folders with headers of their own: one sample, and two."""
    folder, z = _path(spark, "vcf"), F.col("p_size")
    p = table(spark, sf, "part")
    call = lambda name, gt: F.struct(F.lit(name).alias("sample"), gt.alias("gt"))
    for k, sample in ((0, ["x0"]), (1, ["y1", "x1"])):
        first = F.concat((z % 3).cast("string"), F.lit(f"|{k}"))
        calls = F.array(call("x0", first)) if k == 0 else F.array(call("y1", F.lit("0|1")), call("x1", first))
        rows = p.filter(z % 2 == k).select(F.lit("chr1").alias("chr"), F.col("p_partkey").alias("ref_pos"), F.concat(F.lit("rs"), "p_partkey").alias("id"), F.array(F.lit("A"), F.lit("C")).alias("alleles"), F.lit("PASS").alias("filter"), F.lit("GT").alias("format"), calls.alias("genotypes"))
        genomic.write_vcf(rows, f"{folder}/{k}", sample)
    return genomic.read_vcf(spark, f"{folder}/*").select("id", F.inline("genotypes").alias("sample", "gt"))


def _reports(spark, sf):
    """A report an order, with a node for each line; lines that came back have a node of their own."""
    path = _path(spark, "reports")
    node = genomic.report_node
    line = node("line", node("part", F.col("l_partkey").cast("string")), F.when(F.col("l_returnflag") == "R", node("returned", F.col("l_linestatus"))))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), " ").alias("lines"))
    reports_ = lines.select(node("report", node("order", F.col("l_orderkey").cast("string")), node("lines", F.col("lines"))).alias("report"))
    genomic.write_reports(reports_, path, "report")
    return genomic.read_reports(spark, path).withColumn("l_orderkey", F.get(reports.values_of(F.col("tree"), "order"), F.lit(0)).cast("long"))


@query("a28_report_descendants", "SELECT l_orderkey, count(*)::INT AS lines, (count(*) FILTER (l_returnflag = 'R'))::INT AS returned, list(CAST(l_partkey AS VARCHAR) ORDER BY CAST(l_partkey AS VARCHAR)) AS parts FROM lineitem GROUP BY 1")
def report_descendants(spark, sf):
    """Counts of nodes of written reports, and the values of one kind of node."""
    t = F.col("tree")
    return _reports(spark, sf).select("l_orderkey", reports.descendants(t, "line").alias("lines"), reports.descendants(t, "returned").alias("returned"), F.sort_array(reports.values_of(t, "part")).alias("parts"))


@query("f17_report_query", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0")
def report_query(spark, sf):
    """Reports that hold a node of one name at any depth."""
    return _reports(spark, sf).filter(reports.descendants(F.col("tree"), "returned") > 0).select("l_orderkey")


@query("s11_tvf", f"""WITH {_SITES} SELECT 's0' AS sample, chr, pos AS ref_pos, id, alleles, CASE WHEN z % 2 = 0 THEN '0|1' ELSE '1|1' END AS gt FROM s UNION ALL SELECT 's1', chr, pos, id, alleles, CASE WHEN z % 7 = 0 THEN '.|.' ELSE '0|0' END FROM s""")
def tvf(spark, sf):
    """Variants by sample, written from a VCF and read back."""
    path = _path(spark, "tvf")
    genomic.write_tvf(_vcf(spark, sf), path)
    return genomic.read_tvf(spark, path)
