"""Splice graphs: paths against enumeration, edits against graphs drawn by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F
from strandline.operators import splice_graph as sg

EDGE = "t int, src string, dst string, kind string, begin int, end int, change string, annotated boolean"


def enumerate_paths(edges):
    """Every path from a vertex without a way in to one without a way on."""
    out = {}
    for e in edges:
        out.setdefault(e["src"], []).append(e)
    starts = sorted({e["src"] for e in edges} - {e["dst"] for e in edges})

    def walk(v, path):
        if v not in out:
            yield path
        for e in out.get(v, []):
            yield from walk(e["dst"], [*path, e])

    return [p for v in starts for p in walk(v, [])]


def text(path):
    return ">".join([path[0]["src"], *[e["dst"] for e in path]])


def random_graph(rng, n):
    """An acyclic graph: edges lead ahead by any number of vertices; scores are halves, so many tie."""
    kinds = [rng.choice(["GT", "AG", "ATG", "TAG"]) for _ in range(n)]
    v = [f"{k}@{10 * i}" for i, k in enumerate(kinds)]
    edges = []
    for i in range(n):
        for j in range(i + 1, n):
            if rng.random() < 0.35:
                kind = rng.choice(["exon", "intron", "intergenic"])
                scores = [rng.choice([rng.randint(-6, 6) / 2, -math.inf]) if rng.random() < 0.1 else rng.randint(-6, 6) / 2 for _ in range(3)]
                edges.append({"src": v[i], "dst": v[j], "kind": kind, "begin": 10 * i, "end": 10 * j - rng.randint(0, 5), "scores": scores, "score": scores[0], "annotated": rng.random() < 0.7})
    return edges


def by_score(edges, n, phased):
    found = []
    for p in enumerate_paths(edges):
        phase, score = 0, 0.0
        for e in p:
            score += e["scores"][0 if e["kind"] == "intergenic" or not phased else phase]
            if phased and e["kind"] == "intergenic":
                phase = 0
            elif phased and e["kind"] == "exon":
                phase = (phase + e["end"] - e["begin"]) % 3
                if phase and e["dst"][:3] in ("ATG", "TAG"):
                    score = -math.inf
        if math.isfinite(score):
            found.append((-score, text(p), all(e["annotated"] for e in p)))
    return [(t, -s, own) for s, t, own in sorted(found)[:n]]


@pytest.mark.parametrize("phased", [False, True])
def test_best_paths_equal_enumeration(spark, phased):
    rng = random.Random(4 + phased)
    graphs = {t: random_graph(rng, rng.randint(2, 9)) for t in range(60)}
    rows = [(t, e["src"], e["dst"], e["kind"], e["begin"], e["end"], e["score"], e["scores"], e["annotated"]) for t, g in graphs.items() for e in g]
    df = spark.createDataFrame(rows, "t int, src string, dst string, kind string, begin int, end int, score double, scores array<double>, annotated boolean")
    for n in (1, 3, 12):
        got = {}
        for r in sg.best_paths(df, "t", n, phased).orderBy("t", "rank").collect():
            got.setdefault(r["t"], []).append((r["path"], r["score"], r["annotated"]))
        want = {t: x for t, g in graphs.items() if (x := by_score(g, n, phased))}
        assert got == want


def test_paths_that_skip_and_end_early(spark):
    rows = [(1, "L", "a", 1.0), (1, "a", "b", 1.0), (1, "b", "R", 1.0), (1, "a", "R", 9.0), (1, "L", "c", 1.0), (1, "c", "R", 50.0), (2, "L", "R", 2.0), (2, "L", "x", 5.0)]
    df = spark.createDataFrame([(*r, True) for r in rows], "t int, src string, dst string, score double, annotated boolean")
    got = [(r["t"], r["path"], r["score"]) for r in sg.best_paths(df, "t", 9).orderBy("t", "rank").collect()]
    assert got == [(1, "L>c>R", 51.0), (1, "L>a>R", 10.0), (1, "L>a>b>R", 3.0), (2, "L>x", 5.0), (2, "L>R", 2.0)]


def chain(spark, exons=((100, 150), (300, 360), (500, 540)), length=700):
    df = spark.createDataFrame([(1, [{"begin": b, "end": e} for b, e in exons], length)], "t int, exons array<struct<begin:int,end:int>>, length int")
    return sg.annotated_chain(df, "t", "exons", "length")


def edge_set(df):
    return {(r["src"], r["dst"], r["kind"], r["begin"], r["end"]) for r in df.collect()}


def test_chain(spark):
    vertices, edges = chain(spark)
    assert [(r["kind"], r["begin"], r["end"]) for r in vertices.orderBy("begin", "end").collect()] == [
        ("LT", 0, 0), ("TSS", 100, 100), ("GT", 150, 152), ("AG", 298, 300), ("GT", 360, 362), ("AG", 498, 500), ("TES", 540, 540), ("RT", 700, 700)]
    assert edge_set(edges) == {
        ("LT@0", "TSS@100", "intergenic", 0, 100), ("TSS@100", "GT@150", "exon", 100, 150), ("GT@150", "AG@298", "intron", 152, 298), ("AG@298", "GT@360", "exon", 300, 360),
        ("GT@360", "AG@498", "intron", 362, 498), ("AG@498", "TES@540", "exon", 500, 540), ("TES@540", "RT@700", "intergenic", 540, 700)}
    for bad in (((100, 150), (140, 200)), ((100, 150), (153, 200))):
        assert chain(spark, bad)[1].count() == 0
    single = chain(spark, ((10, 20),))[1]
    assert edge_set(single) == {("LT@0", "TSS@10", "intergenic", 0, 10), ("TSS@10", "TES@20", "exon", 10, 20), ("TES@20", "RT@700", "intergenic", 20, 700)}


def broken(spark, *v):
    return spark.createDataFrame([(1, x) for x in v], "t int, v string")


def test_skipping_and_retention_take_other_edges_too(spark):
    _, edges = chain(spark)
    other = spark.createDataFrame([(1, "GT@130", "AG@298", "intron", 132, 298, "", False), (1, "TSS@100", "GT@130", "exon", 100, 130, "", False)], EDGE)
    both = edges.unionByName(other)
    skip = edge_set(sg.skipping_edges(both, broken(spark, "GT@360"), "t"))
    assert skip == {("GT@150", "AG@498", "intron", 152, 498), ("GT@130", "AG@498", "intron", 132, 498)}
    assert edge_set(sg.skipping_edges(both, broken(spark, "AG@298"), "t")) == {("GT@150", "AG@498", "intron", 152, 498)}
    assert edge_set(sg.skipping_edges(both, broken(spark, "GT@150", "AG@498"), "t")) == set()  # first and last exon
    keep = edge_set(sg.retention_edges(both, broken(spark, "AG@298"), "t", 1000))
    assert keep == {("TSS@100", "GT@360", "exon", 100, 360)}
    assert edge_set(sg.retention_edges(both, broken(spark, "GT@150"), "t", 259)) == set()


def test_cryptic_exons(spark):
    vertices, edges = chain(spark)
    site = "t int, kind string, begin int"
    new = spark.createDataFrame([(1, "GT", 250), (1, "AG", 400), (1, "GT", 320)], site)  # the last one lies in an exon
    sites = spark.createDataFrame([(1, "AG", 200), (1, "AG", 199), (1, "AG", 249), (1, "AG", 298), (1, "GT", 402), (1, "GT", 450), (1, "GT", 451), (1, "GT", 360)], site)
    found, more = sg.cryptic_exons(vertices, edges, new, sites, "t", 50)
    assert {(r["kind"], r["begin"]) for r in found.collect()} == {("AG", 200), ("GT", 402), ("GT", 450)}
    assert edge_set(more) == {
        ("AG@200", "GT@250", "exon", 202, 250), ("GT@150", "AG@200", "intron", 152, 200), ("AG@400", "GT@402", "exon", 402, 402), ("GT@402", "AG@498", "intron", 404, 498),
        ("AG@400", "GT@450", "exon", 402, 450), ("GT@450", "AG@498", "intron", 452, 498)}


def tracks(spark, alt):
    """Reference scores 0; alt: {position: score}."""
    values = spark.createDataFrame([(1, [0.0] * 700, [float(alt.get(p, 0)) for p in range(700)])], "t int, r array<double>, a array<double>")
    return sg.prefix_tracks(values, "t", "r", "ref").join(sg.prefix_tracks(values, "t", "a", "alt"), "t")


def regulation(spark, alt, variants, sites, more=()):
    vertices, edges = chain(spark)
    if more:
        vertices = vertices.unionByName(spark.createDataFrame([(1, k, b, b + 2) for k, b in more], "t int, kind string, begin int, end int"))
    v = spark.createDataFrame([(1, b, e) for b, e in variants], "t int, vb int, ve int")
    s = spark.createDataFrame([(1, k, b) for k, b in sites], "t int, kind string, begin int")
    return sg.Regulation(vertices, edges, v, s, tracks(spark, alt), "t", 30)


def test_weakened_exons_are_skipped(spark):
    low = {p: -1.0 for p in range(300, 360)}
    more = [("GT", 160), ("AG", 480), ("AG", 400), ("GT", 140)]
    assert edge_set(regulation(spark, low, [(320, 321)], [], more).weakened()) == {
        (d, a, "intron", int(d[3:]) + 2, int(a[3:])) for d in ("GT@150", "GT@160") for a in ("AG@498", "AG@480", "AG@400")}
    assert edge_set(regulation(spark, {p: -0.6 for p in low}, [(320, 321)], []).weakened()) == set()  # exp(-0.6) is above 0.5
    assert edge_set(regulation(spark, {p: -1.0 for p in range(100, 150)}, [(120, 121)], []).weakened()) == set()  # the first exon has no acceptor


def test_shortened_and_extended_exons(spark):
    low = {p: -1.0 for p in range(300, 360)}
    sites = [("GT", 340), ("GT", 329), ("GT", 352), ("AG", 310)]
    assert edge_set(regulation(spark, low, [(350, 351)], sites).shortened()) == {("AG@298", "GT@340", "exon", 300, 340), ("GT@340", "AG@498", "intron", 342, 498)}
    assert edge_set(regulation(spark, low, [(305, 306)], sites).shortened()) == {("AG@310", "GT@360", "exon", 312, 360), ("GT@150", "AG@310", "intron", 152, 310)}
    assert edge_set(regulation(spark, low, [(330, 331)], sites).shortened()) == set()  # no site between 30 bases from the end and the variant
    high = {p: 1.0 for p in [*range(260, 300), *range(360, 400)]}
    sites = [("AG", 280), ("AG", 269), ("AG", 290), ("GT", 380), ("GT", 391), ("GT", 365)]
    assert edge_set(regulation(spark, high, [(285, 286)], sites).extended()) == {("AG@280", "GT@360", "exon", 282, 360), ("GT@150", "AG@280", "intron", 152, 280)}
    assert edge_set(regulation(spark, high, [(370, 372)], sites).extended()) == {("AG@298", "GT@380", "exon", 300, 380), ("GT@380", "AG@498", "intron", 382, 498)}
    assert edge_set(regulation(spark, {}, [(285, 286), (370, 372)], sites).extended()) == set()


def test_deep_intronic_variants_make_exons(spark):
    high = {p: 1.0 for p in range(410, 440)}
    sites = [("AG", 410), ("AG", 380), ("GT", 430), ("GT", 470), ("GT", 365)]
    edits = regulation(spark, high, [(420, 421)], sites, [("GT", 366), ("AG", 475)])
    assert edge_set(edits.deep_intronic(40, 20, 5.0)) == {
        ("AG@410", "GT@430", "exon", 412, 430), ("GT@360", "AG@410", "intron", 362, 410), ("GT@366", "AG@410", "intron", 368, 410), ("GT@430", "AG@498", "intron", 432, 498), ("GT@430", "AG@475", "intron", 432, 475)}
    assert edge_set(edits.deep_intronic(40, 60, 5.0)) == set()  # too near the intron's begin
    assert edge_set(edits.deep_intronic(40, 20, 50.0)) == set()


def test_windows_map_through_an_alignment(spark):
    values = spark.createDataFrame([(1, [1.0] * 50, [0.0] * 20 + [1.0] * 5 + [0.0] * 30, "20M5I30M")], "t int, r array<double>, a array<double>, cigar string")
    both = sg.prefix_tracks(values, "t", "r", "ref").join(sg.prefix_tracks(values, "t", "a", "alt"), "t").join(values.select("t", "cigar"), "t")
    w = spark.createDataFrame([(1, 10, 30), (1, 40, 60)], "t int, b int, e int")
    got = {r["b"]: r["ratio"] for r in sg.definition_change(w, both, "t", "b", "e", "cigar").collect()}
    assert got[10] == pytest.approx(math.exp(5 / 20 - 15 / 15))
    assert got[40] is None


def test_pruning_by_transcript(spark):
    rows = [(1, "LT@0", "a@1"), (1, "a@1", "RT@9"), (1, "a@1", "x@5"), (1, "y@2", "RT@9"), (2, "LT@0", "a@1"), (2, "b@2", "RT@9")]
    long = [(3, f"v@{i}", f"v@{i + 1}") for i in range(2000)] + [(3, "LT@0", "v@0"), (3, "v@2000", "RT@9")]
    df = spark.createDataFrame([(t, a, b, 1.5, None) for t, a, b in rows + long], "t int, src string, dst string, score double, n int")
    got = sg.pruned_edges(df, "t")
    assert got.columns == df.columns and got.filter("t = 3").count() == len(long)
    assert {(r["t"], r["src"], r["dst"]) for r in got.filter("t < 3").collect()} == {(1, "LT@0", "a@1"), (1, "a@1", "RT@9")}


def test_edge_scores(spark):
    _, edges = chain(spark)
    track = spark.createDataFrame([(1, [1.0] * 700)], "t int, v array<double>")
    exon = sg.prefix_tracks(track, "t", "v", "track").withColumn("kind", F.lit("exon"))
    kept = spark.createDataFrame([(1, "TSS@100", "GT@360", "exon", 100, 360, "intron-retention", False), (1, "AG@400", "GT@402", "exon", 402, 402, "cryptic-exon", False), (1, "AG@690", "RT@700", "exon", 692, 800, "", False)], EDGE)
    got = {(r["src"], r["dst"]): r["score"] for r in sg.scored_edges(edges.unionByName(kept), exon, "t", 0.5, 128.0).collect()}
    assert got == {("LT@0", "TSS@100"): 0.0, ("TSS@100", "GT@150"): 22.0, ("GT@150", "AG@298"): 0.0, ("AG@298", "GT@360"): 27.0, ("GT@360", "AG@498"): 0.0, ("AG@498", "TES@540"): 17.0, ("TES@540", "RT@700"): 0.0}


def test_translations(spark):
    seq = list("C" * 60)
    for at, codon in ((12, "ATG"), (30, "AAA"), (33, "TGA"), (50, "ATG")):
        seq[at : at + 3] = codon
    paths = spark.createDataFrame([(1, "LT@0>TSS@10>GT@18>AG@28>TES@40>RT@60"), (1, "LT@0>TSS@20>TES@40>RT@60"), (1, "LT@0>TSS@48>TES@58>RT@60")], "t int, path string")
    seqs = spark.createDataFrame([(1, "".join(seq), [12, 50])], "t int, seq string, starts array<int>")
    got = {r["path"]: (r["start"], r["stop"], r["protein"]) for r in sg.translations(paths, seqs, "t", "seq", "starts").collect()}
    assert got == {
        "LT@0>TSS@10>GT@18>AG@28>TES@40>RT@60": (2, 11, "MPK") , "LT@0>TSS@20>TES@40>RT@60": (-1, -1, None), "LT@0>TSS@48>TES@58>RT@60": (2, -1, "MP")}


def test_mapped_needs_one_annotated_path(spark):
    rows = [(1, "a", 0.0, True), (2, "a", 0.0, True), (2, "b", 0.0, True), (3, "a", 0.0, False), (4, "a", 9.0, True), (4, "b", 0.0, True)]
    df = spark.createDataFrame(rows, "t int, path string, score double, annotated boolean")
    got = {(r["t"], r["path"]): r["mapped"] for r in sg.likely_paths(df, "t", 0.1).collect()}
    assert got == {(1, "a"): True, (2, "a"): False, (2, "b"): False, (3, "a"): False, (4, "a"): True}


def test_structures_without_broken_sites(spark):
    _, edges = chain(spark)
    lost = broken(spark, "GT@360")
    every = edges.unionByName(sg.skipping_edges(edges, lost, "t")).unionByName(sg.retention_edges(edges, lost, "t", 1000))
    got = {tuple((e.begin, e.end) for e in r.exons) for r in sg.structures(every, lost, "t", 100).collect()}
    assert got == {((100, 150), (500, 540)), ((100, 150), (300, 540))}
    assert sg.structures(edges, lost, "t", 100).count() == 0
    assert [tuple((e.begin, e.end) for e in r.exons) for r in sg.structures(edges, broken(spark, "GT@1"), "t", 100).collect()] == [((100, 150), (300, 360), (500, 540))]


def test_edits_deal_lines_out_once(spark):
    """Chains, broken sites and edits of a transcript stay where its lines were sent (they used to be shuffled for each join)."""
    from strandline.plans import catalogue

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["p13_graph_edits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ENSURE_REQUIREMENTS" not in plan and "SortMergeJoin" not in plan
    assert "REPARTITION_BY_NUM" in plan


def test_sums_by_graph(spark):
    """Sums are those of each transcript's own track, null where it doesn't reach."""
    windows = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 1, 3), (1, "c", 2, 4), (2, "d", 0, 1), (2, "e", -1, 1), (3, "f", 0, 1)], "t long, w string, b int, e int")
    tracks = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [8.0]), (3, None)], "t long, v array<double>")
    got = sg.sums_by_graph(windows, tracks, "t", "b", "e", {"s": F.col("v")}).select(F.inline("rows"))
    assert {r["w"]: r["s"] for r in got.collect()} == {"a": 3.0, "b": 6.0, "c": None, "d": 8.0, "e": None, "f": None}


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sg, "PART_ROWS", 10)
    assert sg.together(spark.range(1000).withColumnRenamed("id", "t"), "t").rdd.getNumPartitions() == 100


def test_edits_by_variants_look_up_within_a_row(spark):
    """Joins of a transcript's vertices, edges, variants and sites held a sorted page each, 1,905 MB a task."""
    from strandline.plans import catalogue

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("p15_cryptic_exons", "p16_weakened", "p16_shortened", "p16_extended", "p16_deep_intronic"):
            plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_graph_row_holds_each_fresh_site_once(spark):
    vertices, edges = chain(spark)
    sites = spark.createDataFrame([(1, "AG", 310), (1, "AG", 310), (1, "AG", 298), (None, "AG", 5), (2, "GT", 9)], "t int, kind string, begin int")
    got = {r.t: (len(r.edges), len(r.vertices), [tuple(s) for s in r.sites]) for r in sg.graph_rows("t", edges, vertices, sites).collect()}
    assert got == {1: (7, 8, [("AG", 310, 312, "AG@310")]), 2: (0, 0, [("GT", 9, 11, "GT@9")])}


def test_paths_are_searched_once(spark):
    """Counting a transcript's likely paths used to search all paths again."""
    from strandline.plans import catalogue

    plan = catalogue.queries()["p20_mapped_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the sums of the tracks, and the search
