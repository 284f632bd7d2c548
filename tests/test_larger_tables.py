"""What only shows on larger tables: several parts a folder, files by region, rows dealt out before they unfold."""

import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.functions import dealing
from strandline.operators import annotations, intervals, models, signals, training
from strandline.plans import training_queries
from strandline.sources import genomic


def test_parts_take_the_header_of_their_own_folder(spark, tmp_path):
    head, site = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t", lambda pos, gt: f"chr1\t{pos}\tr{pos}\tA\tC\t.\tPASS\t.\tGT\t{gt}\n"
    for folder, names, gt in (("0", "s1\n", "0|1"), ("1", "s2\ts3\n", "0|0\t1|0")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.txt").write_text(head + names)
        (tmp_path / folder / "b.txt").write_text(site(5, gt))
    got = {tuple((g.sample, g.gt) for g in r.genotypes) for r in genomic.read_vcf(spark, f"{tmp_path}/*").collect()}
    assert got == {(("s1", "0|1"),), (("s2", "0|0"), ("s3", "1|0"))}
    (tmp_path / "1" / "c.txt").write_text(head + "s4\n")
    with pytest.raises(Exception, match="others differ"):
        genomic.read_vcf(spark, f"{tmp_path}/*").collect()


def test_a_tvf_file_holds_a_region(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(genomic, "REGION", 10)
    rows = [(f"chr{k % 2}", k, f"r{k}", ["A", "C"], [(f"s{k % 3}", f"{k % 2}|1")]) for k in range(40)]
    df = spark.createDataFrame(rows, "chr string, ref_pos int, id string, alleles array<string>, genotypes array<struct<sample:string,gt:string>>")
    genomic.write_tvf(df, f"{tmp_path}/t")
    assert len(list(Path(f"{tmp_path}/t").glob("*/part-*"))) == 8
    got = {(r.sample, r.chr, r.ref_pos, r.id, tuple(r.alleles), r.gt) for r in genomic.read_tvf(spark, f"{tmp_path}/t").collect()}
    assert got == {(f"s{s}", f"chr{k % 2}", k, f"r{k}", ("A", "C"), f"{k % 2}|1" if s == k % 3 else ".") for k in range(40) for s in range(3)}
    with pytest.raises(Exception, match="two genotypes"):
        genomic.write_tvf(df.union(df), f"{tmp_path}/twice")
    (tmp_path / "headless").write_text("s1\t0|1\n")
    with pytest.raises(Exception, match="no line of sites"):
        genomic.read_tvf(spark, str(tmp_path / "headless")).collect()


def test_sequences_are_dealt_out_before_they_unfold(spark):
    assert training_queries._seq(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_refinement_keeps_only_windows_with_the_consensus(spark):
    df = spark.createDataFrame([(1, "GGAATAAACCGGATTAAACCG"), (2, "AAAATAAACC"), (3, None), (4, "CC")], "id int, s string")
    got = [tuple(r) for r in training.allowed_windows(df, "id", "s", 10, 2, ["AATAAA", "ATTAAA"]).orderBy(F.col("pos")).collect()]
    assert got == [(1, 0, "GGAATAAACC"), (1, 10, "GGATTAAACC")]


def test_pairs_a_step_apart_meet_on_the_value_and_keep_repeated_rows(spark):
    rows = [(k, "x" if k % 3 else "y", k % 9) for k in range(60)] + [(1, "x", 1), (99, "x", None), (98, None, 3)]
    got = intervals.step_join(spark.createDataFrame(rows, "id int, g string, v int"), ["g"], "v", 1, 5, "id")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and None not in (a[2], b[2]) and 1 <= b[2] - a[2] <= 5)
    assert sorted((r.earlier, r.later) for r in got.collect()) == want


def test_few_regions_go_to_the_points(spark):
    points = spark.createDataFrame([(k, float(k % 7)) for k in range(50)], "id int, at double")
    regions = spark.createDataFrame([("a", 0.0, 3.0), ("b", 2.0, 1e6)], "name string, lo double, hi double")
    got = intervals.point_in_region(points, regions, "at", "lo", "hi", 2.0)
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.id, r.name) for r in got.collect()) == sorted((k, n) for k in range(50) for n, lo, hi in (("a", 0, 3), ("b", 2, 1e6)) if lo <= k % 7 < hi)
    outside = intervals.point_in_region(points, regions.filter("name = 'a'"), "at", "lo", "hi", 2.0, how="left_anti")
    assert sorted(r.id for r in outside.collect()) == [k for k in range(50) if k % 7 >= 3]


def test_new_sites_stay_in_their_row(spark):
    sensor = signals.Sensor(width=4, offset=1, consensus=("GT",), cutoff=-5.0)
    matrix = spark.createDataFrame([(p, c, -1.0) for p in range(4) for c in "ACGT"], "pos int, symbol string, log_p double")
    row = (7, "ACCTACCTAA", "ACGTACGTAA", "10M", [(2, 3), (6, 7)])
    df = spark.createDataFrame([row, row], "id int, ref string, alt string, cigar string, v array<struct<begin:int,end:int>>")
    got = signals.de_novo_sites(df, "id", "ref", "alt", "cigar", "v", models.matrix_map(matrix), sensor)
    assert sorted((r.id, r.pos, r.score) for r in got.collect()) == [(7, 2, -4.0), (7, 2, -4.0), (7, 6, -4.0), (7, 6, -4.0)]
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_sequences_are_scored_a_row_at_a_time(spark):
    df = spark.createDataFrame([(1, "ABAB"), (2, "BBA"), (1, "C"), (3, ""), (4, None)], "id int, s string")
    got = models.backoff_score(df, "id", F.col("s"), 2)
    one = {"A": 3 / 8, "B": 4 / 8, "C": 1 / 8}
    two = {("A", "B"): 1.0, ("B", "A"): 2 / 3}  # the pairs seen twice
    cost = lambda s: [math.log(two.get((b, c), one[c])) for b, c in zip(" " + s, s, strict=False)]
    scores = {1: cost("ABAB") + cost("C"), 2: cost("BBA")}
    assert {r.id: round(r.score, 9) for r in got.collect()} == {k: round(sum(v) / len(v), 9) for k, v in scores.items()}
    assert not re.search(r"hashpartitioning\(id#\d+L?, before", got._jdf.queryExecution().toString())


def test_words_are_weighed_where_they_are_cut(spark):
    weights = spark.createDataFrame([("AB", 1.0), ("BC", 4.0)], "kmer string, weight double")
    got = models.mean_kmer_weight(spark.createDataFrame([(1, "ABCD"), (2, "ABAB"), (1, "ABC"), (3, "AB")], "id int, s string"), "id", F.col("s"), 2, weights)
    assert {r.id: r.mean_weight for r in got.collect()} == {1: 2.0, 2: 0.5}
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_transcripts_are_tiled_in_parts_that_follow_their_lines(spark, monkeypatch):
    monkeypatch.setattr(dealing, "PART_ROWS", 5)
    rows = [(t, 100 * i, 100 * i + 40 + 60 * (i % 2)) for t in range(100) for i in range(1 + t % 4)]
    tiled = annotations.tile(spark.createDataFrame(rows, "t int, lo int, hi int"), "t", "lo", "hi")
    assert tiled.rdd.getNumPartitions() == len(rows) // 5
    got = sorted(tuple(r)[1:] for r in tiled.filter("t = 3").collect())
    assert got == sorted([("initial-exon", 0, 40), ("intron", 40, 100), ("internal-exon", 100, 200), ("internal-exon", 200, 240), ("intron", 240, 300), ("final-exon", 300, 400)])
    assert [tuple(r)[1:] for r in tiled.filter("t = 4").collect()] == [("single-exon", 0, 40)]


def test_sequences_are_cut_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_PIECES", 3)
    rng = random.Random(5)
    lengths = [("a", 400), ("b", 61), ("none", 100), ("short", 3), ("all", 90), ("zero", 0)]
    masked = [(c, b, b + rng.choice([0, 1, 3, 9])) for c, n in lengths[:2] for b in rng.sample(range(n + 9), n // 4)] + [("a", 200, 275), ("all", 0, 200), ("short", 1, 9), ("gone", 1, 5)]
    want = []
    for c, n in lengths:
        held = {p for k, b, e in masked if k == c for p in range(b, e)}
        at = 0
        while at < n:
            then = at + 5
            while then in held and then < n:
                then += 1
            want.append((c, at, min(then, n)))
            at = min(then, n)
    got = intervals.segments(spark.createDataFrame(masked, "c string, b long, e long"), spark.createDataFrame(lengths, "c string, n long"), "c", "b", "e", "n", 5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.rdd.getNumPartitions() > len(lengths)


def test_upstream_frames_unfold_only_start_codons_that_score(spark):
    plan = training_queries.lost_upstream_orfs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # a row for every place of a transcript, with all of it
