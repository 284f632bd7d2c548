"""Trees, refinement, logistic weights, paired sites, upstream frames and segments against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F
from strandline.operators import intervals, models, signals, training


def chi_square(rows, p, left, q):
    table = {}
    for s in rows:
        table[s[q], s[p] in left] = table.get((s[q], s[p] in left), 0) + 1
    n = sum(table.values())
    row, col = {}, {}
    for (b, x), c in table.items():
        row[b], col[x] = row.get(b, 0) + c, col.get(x, 0) + c
    return sum((table.get((b, x), 0) - r * c / n) ** 2 / (r * c / n) for b, r in row.items() for x, c in col.items())


def grow(rows, width, least, depth, node=1):
    """Splits by recursion over plain lists."""
    if len(rows) < least or depth == 0:
        return []
    best = None
    for p in range(width):
        for left in training.SIDES:
            chis = [chi_square(rows, p, left, q) for q in range(width) if q != p]
            if max(chis) >= training.DEPENDS and (best is None or round(sum(chis), 6) > best[0]):
                best = (round(sum(chis), 6), p, left)
    if best is None:
        return []
    score, p, left = best
    a, b = [s for s in rows if s[p] in left], [s for s in rows if s[p] not in left]
    if min(len(a), len(b)) < least:
        return []
    own = (node, p, left, len(rows), len(a))
    return [own, *grow(a, width, least, depth - 1, 2 * node), *grow(b, width, least, depth - 1, 2 * node + 1)]


def windows(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = [rng.choice("ACGT") for _ in range(5)]
        if s[1] in "AG":
            s[3] = rng.choice("AAAC")
            if s[3] == "A":
                s[4] = rng.choice("GGT")
        out.append("".join(s))
    return out


def test_tree_equals_recursion(spark):
    rows = windows(1, 600)
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    splits = training.train_tree(df, "s", 5, 30, 3)
    assert [(s.node, s.pos, s.left, s.n, s.n_left) for s in splits] == sorted(grow(rows, 5, 30, 3)) and len(splits) >= 2
    assert training.train_tree(df, "s", 5, 601, 3) == []
    leaves = training.train_leaves(df, "s", 5, splits)
    found = {r["s"]: (r["leaf"], r["log_p"]) for r in training.tree_score(df.distinct(), "s", 5, splits, leaves).collect()}
    by_node = {s.node: s for s in splits}
    members = {}
    for s in rows:
        node, log_p = 1, 0.0
        while node in by_node:
            x = by_node[node]
            go = s[x.pos] in x.left
            log_p += math.log((x.n_left if go else x.n - x.n_left) / x.n)
            node = 2 * node + (not go)
        members.setdefault(node, []).append((s, log_p))
    for node, held in members.items():
        for s, log_p in held:
            own = sum(math.log((sum(t[i] == s[i] for t, _ in held) + 1) / (len(held) + 4)) for i in range(5))
            assert found[s] == (node, pytest.approx(log_p + own))


def test_tree_of_independent_or_no_windows(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("".join(rng.choice("AC") for _ in range(1)) + "CCC",) for _ in range(100)], "s string")
    assert training.train_tree(df, "s", 4, 5, 3) == []
    assert training.train_tree(df.limit(0), "s", 4, 1, 3) == []


def test_refinement_takes_the_last_of_ties_and_the_top_fraction(spark):
    seqs = [(1, "GGAATAAACCGGAATAAACCG"), (2, "TTATTAAAGGTT"), (3, "CCAATAAATTC"), (4, "GGGGGGGGGGGG"), (5, "AAAATAAACC")]
    df = spark.createDataFrame(seqs, "id int, s string")
    flat = {f"{p}:{c}": math.log(0.25) for p in range(10) for c in "ACGT"}
    best = {r["id"]: (r["pos"], r["window"]) for r in training.best_windows(df, "id", "s", flat, 10, 2, ["AATAAA", "ATTAAA"]).collect()}
    assert best == {1: (10, "GGAATAAACC"), 2: (0, "TTATTAAAGG"), 3: (0, "CCAATAAATT")}  # 5: the only window is the last one
    seed = spark.createDataFrame([(p, c, math.log(0.25)) for p in range(10) for c in "ACGT"], "pos int, symbol string, log_p double")
    one = {(r["pos"], r["symbol"]): r["log_p"] for r in training.refine(df, "id", "s", seed, 10, 2, ["AATAAA", "ATTAAA"], 0.7, 1).collect()}
    assert one[0, "G"] == pytest.approx(math.log(2 / 6)) and one[0, "T"] == pytest.approx(math.log(2 / 6)) and one[0, "C"] == pytest.approx(math.log(1 / 6))
    many = training.refine(df, "id", "s", seed, 10, 2, ["AATAAA", "ATTAAA"], 0.7, 50)
    assert many.count() == 40


def test_logistic_weights_tell_the_classes(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("ACGT") for _ in range(4)) for _ in range(400)]
    df = spark.createDataFrame([(s, int((s[1] == "G") != (rng.random() < 0.05))) for s in rows], "s string, y int")
    model, weights = training.train_logistic(df, "y", "s", 4, 0.5, [0.01, 1.0], 3)
    again = training.train_logistic(df.repartition(7), "y", "s", 4, 0.5, [0.01, 1.0], 3)[1]
    beta = {(r["pos"], r["symbol"]): r["beta"] for r in weights.collect()}
    assert max(beta, key=lambda k: beta[k] if k[0] is not None else -9) == (1, "G") and len(beta) == 17
    assert {k: round(v, 6) for k, v in beta.items()} == {(r["pos"], r["symbol"]): round(r["beta"], 6) for r in again.collect()}
    scored = spark.createDataFrame([(float(i),) for i in range(250)], "v double")
    assert training.cutoff_for_sensitivity(scored, "v", 0.99).first()["cutoff"] == 2.0
    assert training.cutoff_for_sensitivity(scored.limit(0), "v", 0.99).count() == 0


def test_paired_sites_by_hand(spark):
    flat = lambda w, up=(): models.matrix_map(spark.createDataFrame([(p, c, -1.0 + (0.5 if (p, c) in up else 0)) for p in range(w) for c in "ACGT"], "pos int, symbol string, log_p double"))
    background = spark.createDataFrame([(c, -0.25) for c in "ACGT"], "symbol string, log_p double")
    find = lambda s, up=(): [(r["pos"], r["strand"], r["spacing"], r["score"]) for r in signals.paired_sites(spark.createDataFrame([(1, s)], "id int, s string"), "id", "s", flat(6), 6, 1, "TATA", flat(4), flat(4, up), 4, background, 1, 3).collect()]
    site = "GTATAG" + "A" + "GCAA" + "AA"  # the C at spacing 1
    assert find(site) == [(0, "+", 1, -6 - 4 - 0.75)]
    from_behind = site.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert find(from_behind) == [(0, "-", 1, -10.75)]
    assert find("GTATAG" + "A" + "GCAG" + "AA") == [] and find("GTATAG" + "A" + "GCGA" + "AA") == [] and find(site[:-1]) == []
    two = "GTATAG" + "A" + "GCACAAA"[:6]
    assert [x[2] for x in find(two)] == [1] and [x[2] for x in find(two, ((0, "A"),))] == [3]


def test_lost_upstream_orfs_by_hand(spark):
    flat = lambda w: models.matrix_map(spark.createDataFrame([(p, c, -1.0) for p in range(w) for c in "ACGT"], "pos int, symbol string, log_p double"))
    sensor = signals.Sensor(width=6, offset=2, consensus=("ATG",), cutoff=-6.5)
    ref = "CCATGCCCTAACCATGCCCCCCATGCCC"
    alt = "CCATGCCCTAACCACGCCCCCCATGCCC"
    x = [{"begin": 0, "end": 20}, {"begin": 20, "end": 28}]
    rows = [(1, ref, alt, x, x, "28M", 22), (2, ref, ref, x, x, "28M", 22), (3, ref, ref[:14] + ref[18:], x, [{"begin": 0, "end": 24}], "14M4D10M", 22), (4, ref, ref, x, [{"begin": 0, "end": 1}, {"begin": 5, "end": 28}], "28M", 22)]
    df = spark.createDataFrame(rows, "id int, ref string, alt string, rx array<struct<begin:int,end:int>>, ax array<struct<begin:int,end:int>>, cigar string, cds int")
    got = {(r["id"], r["ref_pos"], r["alt_pos"], r["alt_score"], r["length"]) for r in signals.lost_upstream_orfs(df, "id", "ref", "alt", "rx", "ax", "cigar", "cds", flat(6), sensor, flat(3), 3).collect()}
    assert got == {(1, 13, 13, None, 15), (3, 13, 13, None, 15), (4, 2, 2, None, 9)}


def test_segments_move_off_masked_bases(spark):
    rng = random.Random(8)
    masks, lengths = [], {"a": 500, "b": 90, "c": 7, "d": 100}
    for chrom in "ab":
        masks += [(chrom, b, b + rng.randint(0, 25)) for b in rng.sample(range(480 if chrom == "a" else 95), 25)]
    masks += [("x", 1, 5), ("c", 5, 30)]
    want = set()
    for chrom, n in lengths.items():
        hidden = {p for c, b, e in masks if c == chrom for p in range(b, e)}
        at = 0
        while at < n:
            ahead = min(at + 10, n)
            while ahead < n and ahead in hidden:
                ahead += 1
            want.add((chrom, at, ahead))
            at = ahead
    m = spark.createDataFrame(masks, "chr string, b int, e int").repartition(5)
    size = spark.createDataFrame(list(lengths.items()), "chr string, n int")
    got = [(r["chr"], r["begin"], r["end"]) for r in intervals.segments(m, size, "chr", "b", "e", "n", 10).collect()]
    assert set(got) == want and len(got) == len(want)
    assert intervals.segments(m.limit(0), size.filter(F.lit(False)), "chr", "b", "e", "n", 10).count() == 0
