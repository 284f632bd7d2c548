"""Formats, variants and splice logic on hand-made fixtures."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from strandline.functions import sequences as sq
from strandline.operators import intervals, splicing, variants
from strandline.sources import genomic


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_sequence_functions(spark):
    assert one(spark, sq.reverse_complement(F.col("s")), s="ACGTNa") == "tNACGT"
    assert one(spark, sq.translate_codons(F.col("s")), s="ATGAAATAGC") == "MK*"
    assert one(spark, sq.translate_codons(F.col("s")), s="AT") == ""
    assert one(spark, sq.translate_codons(F.col("s")), s="ANNATG") == "XM"
    assert one(spark, sq.kmers(F.col("s"), 3), s="ACGT") == ["ACG", "CGT"]
    assert one(spark, sq.kmers(F.col("s"), 3), s="AC") == []
    assert one(spark, sq.percent(F.lit(0.12344)),) == pytest.approx(12.34)
    assert one(spark, sq.masked_window(F.col("s"), F.lit(2), 4, 2), s="ACGTAC") == "ac_GT_ac"
    assert one(spark, sq.splice(F.col("s"), F.array(F.struct(F.lit(0).alias("begin"), F.lit(2).alias("end")), F.struct(F.lit(4).alias("begin"), F.lit(6).alias("end")))), s="AACCGG") == "AAGG"


@pytest.mark.parametrize(("ref", "alt", "want"), [("ACGT", "AGT", ("C", "", 11)), ("A", "A", ("", "", 10)), ("AAT", "AT", ("A", "", 10)), ("C", "G", ("C", "G", 10)), ("CAG", "CTG", ("A", "T", 11))])
def test_trim(spark, ref, alt, want):
    assert tuple(one(spark, sq.trim_alleles(F.col("r"), F.col("a"), F.lit(10)), r=ref, a=alt)) == want


def test_cigar_maps_positions(spark):
    segments = sq.cigar_segments(F.lit("3M2I2M2D3M"))
    where = lambda p, d="left": one(spark, sq.map_position(segments, F.lit(p), d))
    assert [where(p) for p in range(10)] == [0, 1, 2, 5, 6, 6, 6, 7, 8, 9]
    assert where(5, "right") == 7
    assert where(20) == 9


def test_haplotypes_rebuild(spark):
    rng = random.Random(3)
    regions, edits, want = [], [], {}
    for g in range(20):
        seq = "".join(rng.choice("ACGT") for _ in range(60))
        out, at, n = "", 0, 0
        for pos in sorted(rng.sample(range(0, 55, 5), 4)):
            ref, alt = seq[pos : pos + rng.randint(0, 2)], "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 3)))
            edits.append((g, pos, ref, alt))
            out, at, n = out + seq[at:pos] + alt, pos + len(ref), n + 1
        want[g] = (out + seq[at:], n)
        regions.append((g, seq))
    r = spark.createDataFrame(regions, "g int, seq string")
    e = spark.createDataFrame(edits, "g int, ref_pos int, ref string, alt string")
    for row in variants.build_haplotypes(r, e, ["g"]).collect():
        assert (row.hap_seq, row.applied, row.mismatched) == (*want[row.g], 0)
        ops = one(spark, sq.parse_cigar(F.lit(row.cigar)))
        assert sum(o.n for o in ops if o.op != "I") == 60
        assert sum(o.n for o in ops if o.op != "D") == len(row.hap_seq)


def test_overlapping_edits_keep_the_longest(spark):
    e = spark.createDataFrame([(1, 5, "ACG", "A"), (1, 6, "C", "T"), (1, 20, "G", "GTT")], "g int, ref_pos int, ref string, alt string")
    got = {(r.ref_pos, r.dropped) for r in variants.chosen_variants(e, ["g"]).collect()}
    assert got == {(5, 1), (20, 0)}


def test_mismatched_reference_is_counted(spark):
    r = spark.createDataFrame([(1, "AAAA")], "g int, seq string")
    e = spark.createDataFrame([(1, 1, "C", "G")], "g int, ref_pos int, ref string, alt string")
    row = variants.build_haplotypes(r, e, ["g"]).first()
    assert (row.hap_seq, row.applied, row.mismatched, row.cigar) == ("AAAA", 0, 1, "4M")


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", {"gene": "g1"}, "ACGT" * 40), ("s2", {"gene": "g2"}, "TT")], "id string, attrs map<string,string>, seq string")
    genomic.write_fasta(df.coalesce(1), str(tmp_path / "f"))
    got = {r.id: (r.attrs, r.seq) for r in genomic.read_fasta(spark, str(tmp_path / "f")).collect()}
    assert got == {"s1": ({"gene": "g1"}, "ACGT" * 40), "s2": ({"gene": "g2"}, "TT")}


def test_gff_and_bed(spark, tmp_path):
    (tmp_path / "a.gff").write_text('# note\nc1\tx\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t";\nc1\tx\texon\t1\t5\t.\t+\t.\tgene_id "g"; transcript_id "t";\n')
    features = genomic.read_gff(spark, str(tmp_path / "a.gff"))
    t = genomic.transcripts(features).first()
    assert [(e.begin, e.end) for e in t.exons] == [(0, 5), (10, 20)]
    assert t.length == 15
    assert tuple(genomic.gene_extents(features).first()) == ("c1", "g", 0, 20)
    (tmp_path / "b.bed").write_text("c1\t1\t5\nc1\t7\t9\tn\t0\t+\n")
    assert genomic.read_bed(spark, str(tmp_path / "b.bed")).count() == 2


def test_vcf_to_major_alleles(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n"
    (tmp_path / "v.vcf").write_text(f"##x\n{head}1\t5\t.\tA\tC,G\t.\tPASS\t.\tGT\t0|1\t1|1\t2|0\n1\t9\tr\tA\t<CN2>\t.\tPASS\t.\tGT\t0|1\t1|1\t.|0\n")
    vcf = genomic.read_vcf(spark, str(tmp_path / "v.vcf"))
    kept = vcf.filter(variants.usable_site(F.col("alleles"), F.col("filter"), F.col("format")))
    assert [(r.chr, r.ref_pos, r.id, r.alleles) for r in kept.collect()] == [("chr1", 4, "chr1@5", ["A", "C", "G"])]
    assert kept.filter(variants.usable_site(F.col("alleles"), F.col("filter"), F.col("format"), strict=True)).count() == 0
    people = spark.createDataFrame([("s1", "p"), ("s2", "p"), ("s3", "q")], "sample string, population string")
    got = {(r.population, r.major, r.n) for r in variants.major_alleles(variants.long_genotypes(kept), people).collect()}
    assert got == {("p", 1, 3), ("q", 0, 1)}


def test_fastq_pairs(spark, tmp_path):
    (tmp_path / "1.fq").write_text("@r1/1\nAC\n+\nII\n@r2/1\nGG\n+\n@I\n")
    (tmp_path / "2.fq").write_text("@r2/2\nTT\n+\nII\n@r3/2\nCC\n+\nII\n")
    pairs, left, right = genomic.pair_reads(genomic.read_fastq(spark, str(tmp_path / "1.fq")), genomic.read_fastq(spark, str(tmp_path / "2.fq")))
    assert ([r.id for r in pairs.collect()], [r.id for r in left.collect()], [r.id for r in right.collect()]) == (["r2"], ["r1"], ["r3"])


def test_junctions_and_reports(spark, tmp_path):
    (tmp_path / "j.bin").write_bytes(struct.pack("<iifc", 3, 9, 2.5, b"+") + struct.pack("<iifc", 4, 8, 1.0, b"-"))
    assert {tuple(r) for r in genomic.read_junctions(spark, str(tmp_path / "j.bin")).collect()} == {(3, 9, 2.5, "+"), (4, 8, 1.0, "-")}
    (tmp_path / "r.txt").write_text("(report (status mapped))\n#====\n(report (status (code x)))\n#====\n")
    assert {r.tree for r in genomic.read_reports(spark, str(tmp_path / "r.txt")).collect()} == {'["report", ["status", "mapped"]]', '["report", ["status", ["code", "x"]]]'}


def test_nmd_cases(spark):
    rows = [([], None, "NO_START"), ([10, 20], None, "NO_STOP"), ([100, 20], 50, "NMD"), ([100, 20], 51, "NONE"), ([200], 5, "NONE")]
    df = spark.createDataFrame(rows, "e array<int>, stop int, want string")
    assert df.filter(splicing.nmd_fate(F.col("e"), F.col("stop")) != F.col("want")).count() == 0


def test_reachable_has_no_depth_limit(spark):
    chain = ["L", *(f"v{k}" for k in range(33)), "R"]
    edges = [*zip(chain, chain[1:], strict=False), ("v30", "v2"), ("v5", "dead"), ("lost", "v9"), ("R", "after"), (None, "v1"), ("v1", None)]
    got = [r.v for r in splicing.reachable(spark.createDataFrame(edges, "src string, dst string"), "L", "R").collect()]
    assert sorted(got) == sorted(chain)


def test_islands_touch_and_nest(spark):
    df = spark.createDataFrame([(1, 0, 10, 1), (1, 2, 3, 2), (1, 10, 12, 3), (1, 20, 21, 4)], "g int, b int, e int, i int")
    assert {(r.begin, r.end, r.members) for r in intervals.islands(df, ["g"], "b", "e", "i").collect()} == {(0, 12, 3), (20, 21, 1)}


def test_alignment():
    from strandline.operators.alignment import matches, read_matrix

    assert matches("MKV", "MKV") == 3
    assert matches("MKVL", "MKL") == 3
    assert matches("", "MK") == 0
    assert matches("AAAA", "TTTT") == 0
    m = read_matrix("  A C\nA 1 -9\nC -9 1\n")
    assert m["A", "C"] == -9
    assert matches("AC", "AC", m) == 2


def test_first_orf(spark):
    for s, want in (("CCATGAAATAAG", (2, 8)), ("ATGAA", (0, -1)), ("CCC", (-1, -1)), ("", (-1, -1))):
        assert tuple(one(spark, sq.first_orf(F.col("s")), s=s)) == want


def test_vcf_files_keep_their_own_samples(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    site = lambda i, gt: f"1\t{i}\trs{i}\tA\tC\t.\tPASS\t.\tGT\t{gt}\n"
    (tmp_path / "a.vcf").write_text(head + "s1\n" + site(5, "0|1") + site(6, "1|1"))
    (tmp_path / "b.vcf").write_text(head + "s2\ts3\n" + site(7, "0|0\t1|0"))
    got = {(r.ref_pos, tuple((g.sample, g.gt) for g in r.genotypes)) for r in genomic.read_vcf(spark, str(tmp_path)).collect()}
    assert got == {(4, (("s1", "0|1"),)), (5, (("s1", "1|1"),)), (6, (("s2", "0|0"), ("s3", "1|0")))}
    (tmp_path / "c.vcf").write_text(site(9, "0|1"))
    with pytest.raises(Exception, match="no header of its own"):
        genomic.read_vcf(spark, str(tmp_path)).collect()
    (tmp_path / "b.vcf").unlink()
    assert {r.ref_pos for r in genomic.read_vcf(spark, str(tmp_path)).collect()} == {4, 5, 8}


def test_gff_with_repeated_keys(spark, tmp_path):
    line = 'chr1\tHAVANA\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t"; tag "basic"; tag "CCDS"; level 2;\n'
    (tmp_path / "g.gtf").write_text("##comment\n" + line)
    (tmp_path / "g.gff3").write_text("chr1\tx\texon\t1\t2\t.\t+\t.\tID=e1;Parent=t1;Parent=t2;tag=a\n")
    r = genomic.read_gff(spark, str(tmp_path / "g.gtf")).first()
    assert (r.transcript_id, r.gene_id, r.attrs["tag"], r.attr_lists["tag"], r.attrs["level"], r.begin) == ("t", "g", "basic", ["basic", "CCDS"], "2", 10)
    r = genomic.read_gff(spark, str(tmp_path / "g.gff3"), gff3=True).first()
    assert (r.transcript_id, r.attr_lists["Parent"]) == ("t1", ["t1", "t2"])


def test_descendants_of_reports(spark, tmp_path):
    from strandline.operators import reports

    (tmp_path / "r").write_text("#====\n(report (transcript (exon 1) (exon 2 (exon 3))) (note exon [exon))\n#====\n(exon (x))\n")
    trees = genomic.read_reports(spark, str(tmp_path / "r"))
    got = {(r.n, r.m, tuple(r.v)) for r in trees.select(reports.descendants(F.col("tree"), "exon").alias("n"), reports.descendants(F.col("tree"), "ex.n").alias("m"), reports.values_of(F.col("tree"), "exon").alias("v")).collect()}
    assert got == {(3, 0, ("1", "2", "3")), (1, 0, ())}
    tricky = '["a", "[\\"exon\\", 1]", "x[", "exon", ["exon"], {"exon" : 2, "y": "exon"}]'
    assert one(spark, reports.descendants(F.col("t"), "exon"), t=tricky) == 2


def test_tvf_refuses_unsorted_sites_and_short_lines(spark, tmp_path):
    rows = [("chr2", 5, "b", ["A", "C"], [("s1", "0|1")]), ("chr1", 9, "a", ["A", "<DEL>"], [("s1", "1|1"), ("s2", "0|0")]), ("chr1", 2, "c", ["G", "T", "C"], [("s2", "2|1")])]
    df = spark.createDataFrame(rows, "chr string, ref_pos int, id string, alleles array<string>, genotypes array<struct<sample:string,gt:string>>")
    genomic.write_tvf(df, f"{tmp_path}/good")
    got = {(r.sample, r.chr, r.ref_pos, r.id, tuple(r.alleles), r.gt) for r in genomic.read_tvf(spark, f"{tmp_path}/good").collect()}
    a, b, c = ("chr1", 9, "a", ("A", "<DEL>")), ("chr2", 5, "b", ("A", "C")), ("chr1", 2, "c", ("G", "T", "C"))
    assert got == {("s1", *a, "1|1"), ("s2", *a, "0|0"), ("s1", *b, "0|1"), ("s2", *b, "."), ("s1", *c, "."), ("s2", *c, "2|1")}
    (tmp_path / "bad").write_text("a:chr1:9:A:C\tx:chr2:1:A:C\tb:chr1:2:A:C\ns1\t0|1\t0|0\t0|0\n")
    with pytest.raises(Exception, match="not sorted"):
        genomic.read_tvf(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "short").write_text("a:chr1:9:A:C\tx:chr2:1:A:C\ns1\t0|1\n")
    with pytest.raises(Exception, match="not a genotype a site"):
        genomic.read_tvf(spark, str(tmp_path / "short")).collect()
