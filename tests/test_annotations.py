"""Annotation operators, exports and wide regions on hand-made rows."""

from pyspark.sql import functions as F
from strandline.functions import sequences as sq
from strandline.operators import annotations, intervals, models, reports


def test_regions_of_any_width(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 3e7), (3, 9.9e8), (4, -3.0), (5, None)], "id int, x double")
    regions = spark.createDataFrame([("open", 0.0, 1e9), ("low", 0.0, 10.0), ("none", 7.0, 7.0)], "r string, a double, b double")
    for width in (1.0, 50000.0):
        got = {(r.id, r.r) for r in intervals.point_in_region(points, regions, "x", "a", "b", width).collect()}
        assert got == {(1, "open"), (1, "low"), (2, "open"), (3, "open")}
        semi = [r.id for r in intervals.point_in_region(points, regions, "x", "a", "b", width, how="left_semi").collect()]
        assert sorted(semi) == [1, 2, 3]
        anti = [r.id for r in intervals.point_in_region(points, regions, "x", "a", "b", width, how="left_anti").collect()]
        assert sorted(anti) == [4, 5]
    assert intervals.point_in_region(points, regions.limit(0), "x", "a", "b", 1.0).count() == 0


def test_first_orf(spark):
    cases = {"CCATGAAATGATAGC": (2, 8), "ATGAAA": (0, -1), "CCC": (-1, -1), "": (-1, -1), "ATG" + "CCC" * 3000 + "TGA": (0, 9003), "A\nTGATGTAG": (4, 7), "xATGA\nATAG": (1, 7)}
    for s, want in cases.items():
        got = spark.createDataFrame([(s,)], "s string").select(sq.first_orf(F.col("s")).alias("o")).first().o
        assert tuple(got) == want, s


def test_biotypes_prefixes_and_tiles(spark):
    f = spark.createDataFrame([("coding", "exon", 1), ("coding", "CDS", 2), ("linc", "exon", 3), ("junk", "CDS", 4), (None, "CDS", 5)], "t string, f string, id int")
    assert [r.id for r in annotations.of_biotypes(f, "t", "f", ["coding", "linc"], "coding").collect()] == [2, 3]
    assert [r.v for r in f.orderBy("id").select(annotations.normal_biotype(F.col("t"), ["coding"]).alias("v")).collect()] == ["coding", "coding", "noncoding", "noncoding", None]
    assert [r.v for r in spark.createDataFrame([("1",), ("chr1",)], "s string").select(annotations.with_prefix(F.col("s"), "chr").alias("v")).collect()] == ["chr1", "chr1"]
    parts = spark.createDataFrame([("a", 0, 10), ("a", 20, 30), ("a", 30, 40), ("b", 5, 6)], "t string, b int, e int")
    got = {tuple(r) for r in annotations.tile(parts, "t", "b", "e").collect()}
    assert got == {("a", "initial-exon", 0, 10), ("a", "intron", 10, 20), ("a", "internal-exon", 20, 30), ("a", "final-exon", 30, 40), ("b", "single-exon", 5, 6)}


def test_slices_and_labels(spark):
    seq = "".join(chr(65 + k % 26) for k in range(103)) + "\né"
    parts = annotations.slices(spark.createDataFrame([("c", seq)], "id string, seq string"), "id", "seq", 10)
    regions = spark.createDataFrame([("c", b, e) for b, e in ((0, 10), (5, 37), (99, 200), (104, 105), (10, 10))], "id string, b int, e int")
    assert {(r.b, r.e): r.seq for r in annotations.read_regions(parts, regions, "id", "b", "e", 10).collect()} == {(b, e): seq[b:e] for b, e in ((0, 10), (5, 37), (99, 200), (104, 105), (10, 10))}
    runs = spark.createDataFrame([("x", 2), ("y", 0), ("z", None)], "l string, n int")
    assert [tuple(r) for r in annotations.labels_of(runs, "l", "n").collect()] == [("x", 0), ("x", 1)]
    a = spark.createDataFrame([(0, "AC"), (1, None)], "o int, s string")
    assert annotations.same_sequences(a, a, "o", "s").first().identical
    assert not annotations.same_sequences(a, a.filter("o = 0"), "o", "s").first().identical
    assert annotations.same_sequences(a.limit(0), a.limit(0), "o", "s").first().identical


def test_exports(spark):
    r = spark.createDataFrame([("t1", 1, "a\tb", None), ("t1", 2, "<&>", 3)], "t string, k int, x string, e int")
    assert sorted(x.line for x in reports.to_tsv(r, ["t", "x", "e"]).collect()) == ["t1\t<&>\t3", "t1\ta b\t"]
    assert {x.line for x in reports.to_xml(r, "r", ["x", "e"]).collect()} == {"<r><x>a\tb</x></r>", "<r><x>&lt;&amp;&gt;</x><e>3</e></r>"}
    assert [x.k for x in reports.first_of_transcript(r, "t", "k").collect()] == [1]
    assert reports.without_errors(r, F.lit(None).cast("boolean"), "e", 2).count() == 1
    g = spark.createDataFrame([("chr1", "exon", 9, 20, "-", "G")], "c string, f string, b int, e int, s string, g string")
    assert reports.to_gff(g, "c", "us", "f", "b", "e", "s", {"gene_id": "g"}).first().line == 'chr1\tus\texon\t10\t20\t.\t-\t.\tgene_id "G";'


def test_weight_array(spark):
    s = spark.createDataFrame([(1, "AC"), (2, "AG"), (3, "AC")], "id int, s string")
    import math

    cells = {(r.pos, r.before, r.c): r.logp for r in models.weight_array(s, F.col("s"), 2).collect()}
    assert cells[1, "A", "C"] == math.log(3 / 5)
    scores = {r.id: r.score for r in models.weight_array_score(s, "id", F.col("s"), 2, models.weight_array(s, F.col("s"), 2)).collect()}
    assert scores[1] == scores[3] > scores[2]
