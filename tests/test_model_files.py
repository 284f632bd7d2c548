"""Model and grammar files, training examples, word bias and individual genomes against plain Python and written fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F
from strandline.operators import examples, variants
from strandline.sources import models as files

WMM = "WMM\nGT\n-7.5\t2\t4\n2\t0\t2\n+\n-0.1\t-2\t-3\t-inf\n-4\t-5\t-6\t-7.25\n"


def written(tmp_path, name, text):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.txt").write_text(text)
    return str(folder)


def test_weight_matrix_file(spark, tmp_path):
    path = written(tmp_path, "m", WMM + WMM.replace("GT", "AG").replace("+", "-").replace("-4\t", "-9\t"))
    got = files.read_weight_matrices(spark, path, "ACGT").collect()
    cells = {(r.signal, r.strand, r.pos, r.symbol): r.log_p for r in got}
    assert len(got) == 16 and cells["GT", "+", 0, "T"] == -math.inf and cells["GT", "+", 1, "A"] == -4.0
    assert cells["AG", "-", 1, "A"] == -9.0 and {(r.cutoff, r.offset, r.consensus_length) for r in got} == {(-7.5, 0, 2)}
    out = str(tmp_path / "again")
    files.write_weight_matrices(files.read_weight_matrices(spark, path, "ACGT"), out, "ACGT")
    assert sorted(map(tuple, files.read_weight_matrices(spark, out, "ACGT").collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize(
    "text,told",
    [(WMM.replace("WMM", "MDD"), "not a weight matrix"), (WMM.replace("-7.25", ""), "not a number for each cell"), (WMM.replace("-7.25", "x"), "not a number for each cell"), (WMM.replace("2\t4", "2\t5"), "other symbols")],
)
def test_bad_weight_matrix_is_told(spark, tmp_path, text, told):
    with pytest.raises(Exception, match=told):
        files.read_weight_matrices(spark, written(tmp_path, "m", text), "ACGT").collect()


def test_empty_folder_of_models(spark, tmp_path):
    assert files.read_weight_matrices(spark, written(tmp_path, "m", "\n"), "ACGT").count() == 0


def test_transitions(spark, tmp_path):
    path = written(tmp_path, "t", "# grammar\nGT -> AG : 3\n  GT->TAG:1\n\nAG -> GT : 2\nGT -> AG : 2\nAG -> ATG : 0\n")
    got = {(r.src, r.dst): r.log_p for r in files.read_transitions(spark, path).collect()}
    assert got == {("GT", "AG"): math.log(0.75), ("GT", "TAG"): math.log(0.25), ("AG", "GT"): 0.0, ("AG", "ATG"): -math.inf}
    with pytest.raises(Exception, match="syntax error in transitions"):
        files.read_transitions(spark, written(tmp_path, "u", "GT AG 1\n")).collect()


def test_topology(spark, tmp_path):
    path = written(tmp_path, "t", "GT -> AG : INTRON\nATG -> GT : INITIAL\nAG->GT: INTERNAL\n# c\nGT has phase 1\nGT has phase 0\nATG strand +\nATG consensus coding\nenable ATG\n")
    got = {r.signal: r for r in files.read_topology(spark, path).collect()}
    gt, atg, ag = got["GT"], got["ATG"], got["AG"]
    assert (gt.follows, gt.precedes, gt.successors, gt.phases) == (["INITIAL", "INTERNAL"], ["INTRON"], ["AG"], [0, 1])
    assert (atg.strand, atg.coding, atg.enabled, atg.phases, atg.follows) == ("+", True, True, [0, 1, 2], [])
    assert (ag.follows, ag.coding, ag.enabled, ag.strand) == (["INTRON"], False, False, None)
    with pytest.raises(Exception, match="syntax error in topology"):
        files.read_topology(spark, written(tmp_path, "u", "GT may be\n")).collect()


def test_isochores(spark, tmp_path):
    cfg = tmp_path / "cfg"
    cfg.mkdir()
    (cfg / "low.cfg").write_text("cutoff = 1 # low\nsame=a\ncutoff = 2\n")
    (cfg / "high.cfg").write_text("cutoff = 9\nmargin = 5\n")
    iso = written(tmp_path, "iso", "# table\nG+C <= 100% : high.cfg\nG+C<=43% : low.cfg\nGLOBAL margin = 7\n")
    table = files.read_isochores(spark, iso, str(cfg))
    got = {(r.config, r.key): (r.value, r.above, r.max_gc) for r in table.collect()}
    low, high = (-math.inf, 0.43), (0.43, 1.0)
    assert got == {("low.cfg", "cutoff"): ("2", *low), ("low.cfg", "same"): ("a", *low), ("low.cfg", "margin"): ("7", *low), ("high.cfg", "cutoff"): ("9", *high), ("high.cfg", "margin"): ("7", *high)}
    ranges = table.select("config", "above", "max_gc").distinct()
    gc = spark.createDataFrame([(0.0,), (0.43,), (0.4301,), (1.0,)], "gc double")
    assert [r.config for r in gc.join(ranges, files.isochore_of(gc["gc"], ranges)).orderBy("gc").collect()] == ["low.cfg", "low.cfg", "high.cfg", "high.cfg"]
    with pytest.raises(Exception, match="no such configuration"):
        files.read_isochores(spark, written(tmp_path, "iso2", "G+C <= 100% : none.cfg\n"), str(cfg)).collect()


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_examples(rows, seqs, donors=("GT", "GC"), acceptors=("AG",)):
    """The examples by loops over whole, turned sequences."""
    best = {}
    for chrom, t, strand, exons in rows:
        s = seqs.get(chrom)
        if s is None or not exons or any(e - b < 3 for b, e in exons) or exons[-1][1] > len(s):
            continue
        n = len(s)
        o, x = (s, exons) if strand == "+" else (turned(s), [(n - e, n - b) for b, e in reversed(exons)])
        pieces = [("start-codon", x[0][0] - 80, 163, ("ATG",)), ("stop-codon", x[-1][1] - 83, 163, ("TAA", "TAG", "TGA"))]
        if len(x) == 1:
            pieces.append(("single-exon", x[0][0] + 3, x[0][1] - x[0][0] - 6, ()))
        else:
            pieces += [("initial-exon", x[0][0] + 3, x[0][1] - x[0][0] - 3, ()), ("final-exon", x[-1][0], x[-1][1] - x[-1][0] - 3, ())]
            pieces += [("internal-exon", b, e - b, ()) for b, e in x[1:-1]]
            for (_, e), (b, _) in zip(x, x[1:]):
                pieces += [("intron", e, b - e, ()), ("donor", e - 80, 162, donors), ("acceptor", b - 82, 162, acceptors)]
        for kind, at, size, wanted in pieces:
            if at < 0 or size <= 0 or at + size > n:
                continue
            seq = o[at : at + size]
            if set(seq) - set("ACGT") or (wanted and seq[80 : 80 + len(wanted[0])] not in wanted):
                continue
            key = (chrom, kind, strand, at if strand == "+" else n - at - size, size)
            best[key] = min(best.get(key, (t, seq)), (t, seq))
    return sorted((k[0], t, *k[1:], seq) for k, (t, seq) in best.items())


def test_examples_equal_loops(spark):
    rng = random.Random(4)
    seqs = {f"c{k}": "".join(rng.choice("ACGT" * 60 + "N") for _ in range(900)) for k in range(6)} | {"short": "ATGC" * 10}
    rows = [("none", "t0", "+", [(90, 120)]), ("c0", "t1", "+", []), ("c0", "t2", "-", [(100, 102), (200, 300)]), ("c0", "t3", "+", [(700, 2000)]), ("short", "t4", "-", [(0, 3), (10, 40)])]
    for k in range(80):
        cuts = sorted(rng.sample(range(0, 880, 5), 2 * rng.randint(1, 4)))
        exons = [(cuts[i], cuts[i + 1]) for i in range(0, len(cuts), 2)]
        rows.append((f"c{k % 6}", f"u{k:02}", rng.choice("+-"), exons))
    rows += [(c, f"v{t}", s, x) for c, t, s, x in rows[10:30]]  # the same pieces again
    made = spark.createDataFrame([(c, t, s, [{"begin": b, "end": e} for b, e in x]) for c, t, s, x in rows], "chr string, t string, strand string, exons array<struct<begin:int,end:int>>")
    table = spark.createDataFrame(list(seqs.items()), "chr string, seq string")
    got = examples.training_examples(made, table, "chr", "t")
    want = plain_examples(rows, seqs)
    assert sorted(map(tuple, got.collect())) == want and {r[2] for r in want} >= {"donor", "acceptor", "intron", "internal-exon", "single-exon"}
    assert examples.training_examples(made.limit(0), table, "chr", "t").count() == 0


def test_caps_hold_whatever_the_partitions(spark):
    rows = [(f"k{i}", "a" if i % 3 else "b") for i in range(900)] + [("z", "c")]
    df = spark.createDataFrame(rows, "k string, class string")
    one = examples.capped(df.coalesce(1), "class", ["k"], {"a": 40, "b": 1000, "none": 3})
    many = examples.capped(df.repartition(7), "class", ["k"], {"a": 40, "b": 1000, "none": 3})
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert {r["class"]: r["count"] for r in one.groupBy("class").count().collect()} == {"a": 40, "b": 300, "c": 1}
    other = examples.capped(df, "class", ["k"], {"a": 40}, seed=2).filter("class = 'a'").collect()
    assert {r.k for r in other} != {r.k for r in one.filter("class = 'a'").collect()}
    assert examples.capped(df, "class", ["k"], {}).count() == 901


def test_word_bias_equals_loops(spark):
    rng = random.Random(5)
    k, chunks, share, biased = 2, [], {}, {}
    for c in range(5):
        seq = "".join(rng.choice("ACGT") for _ in range(60))
        depth = [float(rng.randint(0, 9)) for _ in range(60)]
        if c == 3:
            depth = depth[:20]  # positions without a value
        if c == 4:
            depth = [0.0] * 60
        chunks.append((f"c{c}", seq, depth, [("b", [(2, 12), (20, 40)]), ("a", [(5, 35)]), ("s", [(0, 9)])]))
        exons = [(5, 35)]  # of two transcripts of 30 bases the smaller name
        s = "".join(seq[b:e] for b, e in exons)
        own, deep = {}, {}
        for i in range(len(s) - k):
            own[s[i : i + k]] = own.get(s[i : i + k], 0) + 1
        for b, e in exons:
            for i in range(b, e - k):
                at = [depth[p] if p < len(depth) else 0.0 for p in range(i, i + k)]
                deep[seq[i : i + k]] = deep.get(seq[i : i + k], 0) + sum(at) / k
        for into, counts in ((share, own), (biased, deep)):
            for w, n in counts.items():
                into[w] = into.get(w, 0) + (n / sum(counts.values()) if sum(counts.values()) else 0)
    t = spark.createDataFrame([(c, n, [{"begin": b, "end": e} for b, e in x]) for c, _, _, ts in chunks for n, x in ts], "chunk string, t string, exons array<struct<begin:int,end:int>>")
    q = spark.createDataFrame([c[:3] for c in chunks], "chunk string, seq string, depth array<double>")
    got = {r.word: (r.share, r.biased, r.ratio) for r in examples.word_bias(t, q, "chunk", "t", k).collect()}
    assert set(got) == set(share)
    for w in share:
        a, b = share[w] / sum(share.values()), biased.get(w, 0) / sum(biased.values())
        assert got[w] == pytest.approx((a, b, b / a))
    assert examples.word_bias(t.limit(0), q, "chunk", "t", k).count() == 0


def test_words_across_a_splice_site_have_no_coverage(spark):
    t = spark.createDataFrame([("c", "t", [{"begin": 0, "end": 3}, {"begin": 6, "end": 9}])], "chunk string, t string, exons array<struct<begin:int,end:int>>")
    q = spark.createDataFrame([("c", "AAATTTCCC", [2.0] * 9)], "chunk string, seq string, depth array<double>")
    got = {r.word: r.biased for r in examples.word_bias(t, q, "chunk", "t", 2).collect()}
    assert got == {"AA": 0.5, "AC": 0.0, "CC": 0.5}


def test_individual_genomes_equal_plain_edits(spark):
    rng = random.Random(6)
    seqs = {c: "".join(rng.choice("ACGT") for _ in range(300)) for c in ("chr1", "chr2")}
    sites, calls = {}, []
    for c in seqs:
        for p in range(4, 296, 9):
            ref = seqs[c][p : p + rng.randint(1, 4)]
            sites[c, p] = [ref, ref[0] + "GATTACA"[: rng.randint(0, 4)], "T"]
            for who in ("x", "y"):
                calls += [(c, p, f"{c}@{p}", sites[c, p], who, h, rng.choice([0, 0, 1, 2, None])) for h in (0, 1)]
    genes = [("g1", "chr1", 20, 60), ("g2", "chr1", 280, 299), ("g3", "chr2", 0, 300), ("g4", "chrX", 5, 9), ("g5", "chr2", 150, 151)]
    g = spark.createDataFrame(calls, "chr string, ref_pos int, id string, alleles array<string>, sample string, hap int, allele int")
    got = variants.individual_genomes(spark.createDataFrame(genes, "gene string, chr string, begin long, end long"), spark.createDataFrame(list(seqs.items()), "chr string, seq string"), g, 10, 64.0)
    rows = {(r.gene, r.sample, r.hap): (r.begin, r.end, r.hap_seq, r.applied) for r in got.collect()}
    want = {}
    for name, c, b, e in genes:
        if c not in seqs:
            continue
        b, e = max(0, b - 10), min(300, e + 10)
        for who in ("x", "y"):
            for h in (0, 1):
                s, n = seqs[c][b:e], 0
                for cc, p, _, alleles, w, hh, allele in reversed(calls):
                    if (cc, w, hh) == (c, who, h) and allele and b <= p and p + len(alleles[0]) <= e:
                        s, n = s[: p - b] + alleles[allele] + s[p - b + len(alleles[0]) :], n + 1
                want[name, who, h] = (b, e, s, n)
    assert rows == want and got.filter("mismatched > 0").count() == 0


def test_haplotype_of_a_long_sequence_and_many_edits(spark):
    seq = "ACGTTGCA" * 25000
    edits = [(p, seq[p : p + 2], "G" * (p % 4)) for p in range(0, 199000, 40)] + [(3, "C", "T")]
    regions = spark.createDataFrame([("r", seq), ("empty", "")], "k string, seq string")
    rows = spark.createDataFrame([("r", *e) for e in edits], "k string, ref_pos int, ref string, alt string")
    got = {r.k: r for r in variants.build_haplotypes(regions, rows, ["k"]).collect()}
    out = seq
    for p, ref, alt in sorted(edits[:-1], reverse=True):
        out = out[:p] + alt + out[p + 2 :]
    assert got["r"].hap_seq == out and (got["r"].applied, got["r"].mismatched) == (len(edits) - 1, 1)
    assert (got["empty"].hap_seq, got["empty"].cigar) == ("", "")
    kept = sum(int(n) for n, k in __import__("re").findall(r"(\d+)([MID])", got["r"].cigar) if k in "MI")
    assert kept == len(out)
