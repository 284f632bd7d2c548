"""Signal operators against plain Python on hand-made rows."""

import math
import random

from pyspark.sql import functions as F
from strandline.operators import annotations, models, signals
from strandline.sources import genomic

CELLS = {(p, c): -0.5 - ((p * 3 + "ACGT".index(c) * 5) % 7) / 3 for p in range(6) for c in "ACGT"}
SITE = signals.Sensor(width=6, offset=2, consensus=("GT", "AG"), cutoff=-12.0)


def matrix(spark):
    return models.matrix_map(spark.createDataFrame([(p, c, v) for (p, c), v in CELLS.items()], "pos int, symbol string, log_p double"))


def score(w):
    return sum(CELLS[p, c] for p, c in enumerate(w)) if len(w) == 6 and set(w) <= set("ACGT") else None


def dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def test_scan_both_strands(spark):
    rows = [(1, dna(1, 60)), (2, "ACGNNACGTACG"), (3, "ACG"), (4, ""), (5, None)]
    got = {(r.id, r.pos, r.strand): r.score for r in signals.scan(spark.createDataFrame(rows, "id int, s string"), "id", "s", matrix(spark), 6, -10.0).collect()}
    want = {}
    for ident, s in rows:
        for i in range(len(s or "") - 5):
            w = s[i : i + 6]
            for strand, x in (("+", w), ("-", w[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                if score(x) is not None and score(x) >= -10.0:
                    want[ident, i, strand] = score(x)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cutoff_for(spark):
    def cut(scores, n):
        return signals.cutoff_for(spark.createDataFrame([(float(x),) for x in scores], "s double"), "s", n).first().cutoff

    assert cut([5, 4, 3], 2) == 3.5
    assert cut([5, 4, 3], 3) is None and cut([5, 4], 9) is None
    assert cut([9, 5, 5, 5, 5, 1], 2) == 7.0  # above the tie
    assert cut([9, 5, 5, 5, 1], 3) == 3.0  # below it
    assert cut([5, 5, 5, 5, 1], 1) == 0.0
    assert cut([9, 5, 5], 2) == math.inf


def test_de_novo_sites(spark):
    ref = dna(3, 80)
    alt = ref[:20] + "GGTAAG" + ref[20:50] + ref[53:]  # an insertion of six and a deletion of three
    cigar, variants = "20M6I30M3D27M", [(20, 26), (56, 56)]
    to_ref = list(range(20)) + [None] * 6 + list(range(20, 50)) + list(range(53, 80))
    want = {}
    for b, e in variants:
        for at in range(max(b - 5, 0), e):
            w = alt[at : at + 6]
            if len(w) < 6 or w[2:4] not in SITE.consensus or score(w) < SITE.cutoff + math.log(2):
                continue
            v = ref[to_ref[at] : to_ref[at] + 6] if to_ref[at] is not None else ""
            if len(v) == 6 and v[2:4] in SITE.consensus and (score(v) >= SITE.cutoff or score(w) - score(v) < math.log(2)):
                continue
            want[at + 2] = score(w)
    df = spark.createDataFrame([(1, ref, alt, cigar, variants)], "id int, ref string, alt string, cigar string, v array<struct<begin:int,end:int>>")
    got = {r.pos: r.score for r in signals.de_novo_sites(df, "id", "ref", "alt", "cigar", "v", matrix(spark), SITE).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_variant_classes(spark):
    exons = spark.createDataFrame([("t", "CDS", 10, 20), ("t", "CDS", 30, 40), ("t", "UTR", 50, 60)], "t string, kind string, begin int, end int")
    v = [(1, 5, "A", "G"), (2, 12, "A", "GG"), (3, 19, "AA", "A"), (4, 25, "A", "G"), (5, 29, "A", "T"), (6, 55, "A", "T"), (7, 60, "A", "T"), (8, 31, "AAAA", "A")]
    df = spark.createDataFrame([("t", *x) for x in v], "t string, id int, pos int, ref string, alt string")
    got = {(r.id, r.element, r.distance, r.near_splice, r.frameshift) for r in signals.classify_variants(df, exons, "t", "id").collect()}
    assert got == {
        (1, "INTERGENIC", None, False, False), (2, "CDS", 7, False, True), (3, "CDS", 1, True, True), (3, "SPLICE_SITE", None, False, False), (4, "INTRON", None, False, False),
        (5, "SPLICE_SITE", None, False, False), (6, "UTR", None, False, False), (7, "INTERGENIC", None, False, False), (8, "CDS", 1, True, False),
    }


def test_well_formed(spark):
    rows = [
        ("ATGAAAGTCCAGAAATAA", [(0, 6), (12, 18)], False, (False, False, False, False, True)),
        ("ATGTAAGTCCAGAAATAA", [(0, 6), (12, 18)], False, (False, False, True, False, False)),
        ("ATGAAACTCCAGAAATAA", [(0, 6), (12, 18)], False, (False, False, False, True, False)),
        ("ATGAAAAAAGTCCAGAAATAA", [(3, 9), (15, 18)], False, (True, False, False, False, False)),
        ("CCATGAAAAAAGTCCAGAAATAA", [(5, 11), (17, 20)], False, (False, False, False, False, True)),
        ("ATGAAAGTCCAGAAAAAA", [(0, 6), (12, 18)], True, (False, False, True, False, False)),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "s string, x array<struct<begin:int,end:int>>, d boolean")
    got = df.select(signals.well_formed(F.col("s"), F.col("x"), F.col("d"), ("GT",), ("AG",)).alias("f")).collect()
    assert [tuple(r.f) for r in got] == [r[3] for r in rows]


def test_chi_square_confidence(spark):
    # P(X <= x), from tables
    known = {2: [(5.991, 0.95), (1.386, 0.5)], 3: [(7.815, 0.95), (2.366, 0.5), (0.352, 0.05)], 5: [(11.070, 0.95), (4.351, 0.5)], 4: [(9.488, 0.95)]}
    for k, pairs in known.items():
        for x, p in pairs:
            got = spark.createDataFrame([(x,)], "x double").select(models.chi_square_confidence(F.col("x"), k).alias("p")).first().p
            assert abs(got - p) < 2e-4, (k, x)


def test_start_codons(spark):
    long = {(p, c): CELLS[p % 6, c] for p in range(8) for c in "ACGT"}
    as_matrix = lambda cells: models.matrix_map(spark.createDataFrame([(p, c, v) for (p, c), v in cells.items()], "pos int, symbol string, log_p double"))
    short = {(p, c): v for (p, c), v in CELLS.items() if p < 3}
    rows = [(k, dna(k, 5 + k * 3), k % 4) for k in range(12)] + [(50, "", 0), (51, None, 0)]

    def start(s, pos, cutoff):
        at = pos
        while at - 3 + 8 < len(s):
            near = at == pos or at < 3
            cells, w = (short, s[at : at + 3]) if near else (long, s[at - 3 : at + 5])
            whole = len(w) == (3 if near else 8)
            if whole and sum(cells[p, c] for p, c in enumerate(w)) >= cutoff:
                return at
            at += 1
        return -1

    for cut in (-8.0, -4.0, -2.5):
        tried = signals.Sensor(8, 3, ("ATG",), cut)
        df = spark.createDataFrame(rows, "id int, s string, pos int")
        got = {r.id: r.start for r in signals.start_codons(df, "id", "s", "pos", as_matrix(long), tried, as_matrix(short), 3).collect()}
        assert got == {k: start(s or "", pos, cut) for k, s, pos in rows}, cut


def test_flanking_signals(spark):
    df = spark.createDataFrame([(1, "initial-exon", 10, 20, "+"), (2, "final-exon", 10, 20, "-"), (3, "intron", 0, 5, "+"), (4, "internal-exon", 10, 20, "-")], "id int, k string, b int, e int, s string")
    got = {tuple(r) for r in annotations.flanking_signals(df, ["id"], "k", "b", "e", "s", {"GT": 5}).collect()}
    assert got == {(1, "ATG", 10, 10), (1, "GT", 20, 15), (2, "NEG_TAG", 10, 10), (2, "NEG_AG", 20, 20), (4, "NEG_GT", 8, 8), (4, "NEG_AG", 20, 20)}


def test_vcf_written_sorted_with_header_first(spark, tmp_path):
    rows = [("chr2", 5, "b", ["A", "G"], None, "GT", [("y", "0|1")]), ("chr1", 9, "a", ["A"], "PASS", "GT", [("y", "0|0"), ("x", "1|1")])]
    df = spark.createDataFrame(rows, "chr string, ref_pos int, id string, alleles array<string>, filter string, format string, genotypes array<struct<sample:string,gt:string>>")
    genomic.write_vcf(df, str(tmp_path / "v"), ["x", "y"])
    lines = "".join(f.read_text() for f in sorted((tmp_path / "v").glob("part-*"))).split("\n")
    assert [x.split("\t")[0] for x in lines[:4]] == ["##fileformat=VCFv4.2", "#CHROM", "chr1", "chr2"]
    assert lines[3] == "chr2\t6\tb\tA\tG\t.\t.\t.\tGT\t.\t0|1"
    back = {r.id: (r.ref_pos, [(g.sample, g.gt) for g in r.genotypes]) for r in genomic.read_vcf(spark, str(tmp_path / "v")).collect()}
    assert back == {"a": (9, [("x", "1|1"), ("y", "0|0")]), "b": (5, [("x", "."), ("y", "0|1")])}


def test_indexed_regions(spark, tmp_path):
    df = spark.createDataFrame([("a", float(p)) for p in range(0, 100, 7)] + [("b", 50.0)], "c string, p double")
    genomic.write_indexed(df, str(tmp_path / "i"), "c", "p", 10)
    assert sorted(r.p for r in genomic.read_indexed(spark, str(tmp_path / "i"), "a", 14, 42, 10).collect()) == [14.0, 21.0, 28.0, 35.0]
