"""Signals along sequences: scans with weight matrices, start codons, new and cryptic sites, variants by element, RNA evidence.

A sensor is a weight matrix, a one-row table of a map '<position>:<character>' -> log probability (models.matrix_map), and
a Sensor with its fixed numbers. Windows are cut in one pass over a sequence and scored inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from . import intervals

#: Bases from a splice site within which a coding variant counts as near it (default of near_splice).
NEAR_SPLICE = 3


@dataclass(frozen=True)
class Sensor:
    """width of the window, where the consensus begins in it, the consensus strings allowed, and the least score."""

    width: int
    offset: int
    consensus: tuple[str, ...]
    cutoff: float


def _windows(df: DataFrame, keep: list[str | Column], seq: str, width: int, names: tuple[str, str] = ("pos", "window")) -> DataFrame:
    return df.select(*keep, F.posexplode(sq.kmers(F.upper(seq), width)).alias(*names))


def _with(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """The matrix beside every row: one row of width x alphabet cells, whatever the data."""
    return df.crossJoin(F.broadcast(matrix.select("matrix")))


def _consensus_at(window: Column, sensor: Sensor) -> Column:
    return F.substring(window, F.lit(sensor.offset + 1), F.lit(len(sensor.consensus[0]))).isin(*sensor.consensus)


def scan(df: DataFrame, ident: str, seq: str, matrix: DataFrame, width: int, cutoff: float | None = None, background: DataFrame | None = None) -> DataFrame:
    """(ident, pos, strand, score) of every window on both strands that scores the cutoff or more.

    background: (symbol, log_p) of an order-0 model that is taken from the score, on either strand. A window with a
    character the matrix has no cell for makes no prediction.
    """
    found = _with(_windows(df, [ident], seq, width), matrix)
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("window").alias("w")), F.struct(F.lit("-").alias("strand"), sq.reverse_complement(F.col("window")).alias("w"))))
    each = found.select(ident, "pos", "matrix", strands.alias("s")).select(ident, "pos", "matrix", "s.strand", "s.w")
    score = sq.weight_matrix_score(F.col("w"), F.col("matrix"), width)
    if background is not None:
        table = background.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "log_p"))).alias("b"))
        each = each.crossJoin(F.broadcast(table))  # one row, as small as the alphabet
        score -= F.aggregate(F.split("w", ""), F.lit(0.0), lambda acc, c: acc + F.try_element_at(F.col("b"), c))
    scored = each.select(ident, "pos", "strand", score.alias("score")).filter("score is not null")
    return scored if cutoff is None else scored.filter(F.col("score") >= cutoff)


def cutoff_for(scored: DataFrame, score: str, wanted: int) -> DataFrame:
    """One row, cutoff: lets through as near to `wanted` predictions as ties allow; null if all pass.

    Scores are counted first, so the ordered window holds different scores. Between two scores the cutoff lies midway. When
    the wanted-th and the next one tie, it goes above the tie if that is nearer by more than one, to 0 if nothing is above,
    and else below it; a tie that ends the list then lets nothing through.
    """
    counts = scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("s"))
    run = counts.select("s", "n", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.lead("s").over(down).alias("below"), F.lag("s").over(down).alias("above"))
    last = run.filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
    over, under = F.col("upto") - wanted, wanted - (F.col("upto") - F.col("n"))
    lower, upper = (F.col("s") + F.col("below")) / 2, (F.col("s") + F.col("above")) / 2
    tied = F.when(under < over - 1, F.coalesce(upper, F.lit(0.0))).otherwise(F.coalesce(lower, F.lit(float("inf"))))
    chosen = F.when(over == 0, lower).otherwise(tied)
    return last.agg(F.first(chosen).alias("cutoff"))


def start_codons(df: DataFrame, ident: str, seq: str, pos: str, long: DataFrame, sensor: Sensor, short: DataFrame, short_width: int) -> DataFrame:
    """(ident, start): the first position from pos on in a spliced transcript that scores the long sensor's cutoff, -1 if none.

    The first position tried, and those too near the 5' end for the long window, take the short model, which begins at the
    codon; all others the long one. A long window has to end before the transcript does.
    """
    off, width = sensor.offset, sensor.width
    fits = F.col("__n") > F.col("at") - off + width
    rows = df.select(F.col(ident), F.upper(seq).alias("__s"), F.length(seq).alias("__n"), F.col(pos).alias("__from"))
    far = _windows(rows, [ident, "__n", "__from"], "__s", width, ("at", "window")).withColumn("at", F.col("at") + off)
    far = _with(far.filter(fits & (F.col("at") > F.col("__from"))), long)
    far = far.select(ident, "at", sq.weight_matrix_score(F.col("window"), F.col("matrix"), width).alias("score"))
    tried = F.when(F.col("__from") + 1 < off, F.sequence(F.col("__from"), F.lit(off - 1))).otherwise(F.array("__from"))
    near = rows.filter("__from >= 0").select("*", F.explode(tried).alias("at")).filter(fits)
    near = _with(near.select(ident, "at", F.substring("__s", F.col("at") + 1, F.lit(short_width)).alias("window")), short)
    near = near.select(ident, "at", sq.weight_matrix_score(F.col("window"), F.col("matrix"), short_width).alias("score"))
    hits = far.unionByName(near).filter(F.col("score") >= sensor.cutoff).groupBy(ident).agg(F.min("at").alias("start"))
    return df.select(ident).join(hits, ident, "left").select(ident, F.coalesce("start", F.lit(-1)).alias("start"))


def de_novo_sites(df: DataFrame, ident: str, ref: str, alt: str, cigar: str, variants: str, matrix: DataFrame, sensor: Sensor) -> DataFrame:
    """(ident, pos, score): consensus positions in alt of sites that variants make.

    variants: array<struct<begin, end>> in alt. Every window that touches one is tried once, however many it touches. A site
    scores twice the cutoff's probability or more; where its window's begin lies in ref too and the consensus stands there,
    ref scores below the cutoff and half of it or less.
    """
    width = sensor.width
    spans = F.transform(F.col(variants), lambda v: F.when(v["end"] > v["begin"] - width + 1, F.sequence(F.greatest(v["begin"] - width + 1, F.lit(0)), F.greatest(v["end"] - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")))
    spots = F.array_distinct(F.flatten(spans))
    rows = df.select(ident, spots.alias("spots"), F.array(F.struct(sq.kmers(F.upper(alt), width).alias("a"), sq.kmers(F.upper(ref), width).alias("r"), F.filter(sq.cigar_segments(F.col(cigar)), lambda s: s["op"] == "M").alias("m"))).alias("own"))

    def site(own: Column, at: Column) -> Column:
        beside = F.filter(own["m"], lambda s: (s["alt"] <= at) & (at < s["alt"] + s["n"]))
        was = F.array_max(F.transform(beside, lambda s: s["ref"] + at - s["alt"]))
        return F.struct(at.alias("at"), F.get(own["a"], at).alias("w"), F.get(own["r"], was).alias("v"))

    # the lambda's variable holds a row's windows and segments, so that they are cut once; nothing leaves its row
    cut = F.flatten(F.transform("own", lambda own: F.filter(F.transform("spots", lambda at: site(own, at)), lambda x: x["w"].isNotNull() & _consensus_at(x["w"], sensor))))
    both = _with(rows.select(ident, F.inline(cut)).withColumn("v", F.when(_consensus_at(F.col("v"), sensor), F.col("v"))), matrix)
    both = both.select(ident, "at", "v", sq.weight_matrix_score(F.col("w"), F.col("matrix"), width).alias("score"), sq.weight_matrix_score(F.col("v"), F.col("matrix"), width).alias("was"))
    fresh = F.col("v").isNull() | F.col("was").isNull() | ((F.col("was") < sensor.cutoff) & (F.col("score") - F.col("was") >= F.ln(F.lit(2.0))))
    return both.filter((F.col("score") >= F.lit(sensor.cutoff) + F.ln(F.lit(2.0))) & fresh).select(ident, (F.col("at") + sensor.offset).alias("pos"), "score")


def cryptic_sites(broken: DataFrame, sequences: DataFrame, ident: str, seq: str, matrix: DataFrame, sensor: Sensor, shift: int) -> DataFrame:
    """(ident, vertex, pos, score): sites in the altered sequence within `shift` bases of a broken one, itself excluded.

    broken: ident, vertex, begin, end. Its sites are found by bins of positions, so no sequence meets all its vertices.
    """
    size = len(sensor.consensus[0])
    found = _windows(sequences, [ident, F.length(seq).alias("__n")], seq, sensor.width, ("at", "w")).filter(_consensus_at(F.col("w"), sensor))
    found = found.filter(F.col("at") < F.col("__n") - sensor.width)
    reach = broken.select(ident, "vertex", F.col("begin").alias("b"), F.greatest(F.col("begin") - shift - sensor.offset, F.lit(0)).alias("lo"), (F.col("end") + shift - size - sensor.offset).alias("hi"))
    near = intervals.point_in_region(found, reach, "at", "lo", "hi", float(max(2 * shift, 1)), on=[ident])
    scored = _with(near.filter(F.col("at") + sensor.offset != F.col("b")), matrix)
    scored = scored.select(ident, "vertex", (F.col("at") + sensor.offset).alias("pos"), sq.weight_matrix_score(F.col("w"), F.col("matrix"), sensor.width).alias("score"))
    return scored.filter(F.col("score") >= sensor.cutoff)


def inherited_edges(sites: DataFrame, edges: DataFrame, ident: str) -> DataFrame:
    """(ident, src, dst): edges of each cryptic site (vertex, pos), a copy of every edge that its broken vertex has."""
    name = F.concat_ws("@", F.col("vertex").cast("string"), F.col("pos").cast("string"))
    s = sites.select(ident, F.col("vertex").cast("string").alias("vertex"), name.alias("site"))
    e = edges.select(ident, F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    into = e.withColumnRenamed("dst", "vertex").join(s, [ident, "vertex"]).select(ident, "src", F.col("site").alias("dst"))
    return into.unionByName(e.withColumnRenamed("src", "vertex").join(s, [ident, "vertex"]).select(ident, F.col("site").alias("src"), "dst"))


def classify_variants(variants: DataFrame, exons: DataFrame, transcript: str, ident: str, width: float = 1024.0, near: int = NEAR_SPLICE) -> DataFrame:
    """(transcript, ident, element, distance, near_splice, frameshift), a row for each element a variant touches.

    variants: transcript, ident, pos, ref, alt. exons: transcript, kind (CDS or UTR), begin, end. A variant that begins
    outside its transcript is INTERGENIC. Two bases at either end of an intron make a SPLICE_SITE, the rest is INTRON.
    distance is that of a coding variant to the nearer splice site of its exon, null without one.
    """
    order = Window.partitionBy(transcript).orderBy("begin", "end")
    laid = exons.withColumn("i", F.row_number().over(order)).withColumn("next", F.lead("begin").over(order))
    laid = laid.withColumn("n", F.count("*").over(Window.partitionBy(transcript)))
    extent = exons.groupBy(transcript).agg(F.min("begin").alias("tb"), F.max("end").alias("te"))
    own = laid.select(transcript, F.upper("kind").alias("element"), F.col("begin").cast("long").alias("b"), F.col("end").cast("long").alias("e"), (F.col("i") > 1).alias("acceptor"), (F.col("i") < F.col("n")).alias("donor"))
    gaps = laid.filter(F.col("next") > F.col("end")).select(transcript, F.lit("INTRON").alias("element"), F.col("end").cast("long").alias("b"), F.col("next").cast("long").alias("e"), F.lit(False).alias("acceptor"), F.lit(False).alias("donor"))
    v = variants.select(transcript, ident, F.col("pos").cast("long").alias("pos"), (F.col("pos") + F.length("ref")).cast("long").alias("stop"), (F.length("ref") - F.length("alt")).alias("change"))
    v = v.join(extent, transcript).withColumn("inside", (F.col("pos") >= F.col("tb")) & (F.col("pos") < F.col("te")))
    met = intervals.overlap_join(v.filter("inside"), own.unionByName(gaps), [transcript], ("pos", "stop"), ("b", "e"), width)
    pos, stop, b, e = (F.col(c) for c in ("pos", "stop", "b", "e"))
    at_site = (F.col("element") == "INTRON") & ((pos < b + 2) | (stop > e - 2))
    element = F.when(at_site, "SPLICE_SITE").otherwise(F.col("element"))
    distance = F.when(element == "CDS", F.least(F.when(F.col("donor"), F.least(F.abs(pos - e), F.abs(stop - e))), F.when(F.col("acceptor"), F.least(F.abs(pos - b), stop - b))))
    shifted = (element == "CDS") & (F.abs("change") % 3 != 0)
    told = met.select(transcript, ident, element.alias("element"), distance.alias("distance"), F.coalesce(distance.between(0, near), F.lit(False)).alias("near_splice"), shifted.alias("frameshift"))
    outside = v.filter("not inside").select(transcript, ident, F.lit("INTERGENIC").alias("element"), F.lit(None).cast("long").alias("distance"), F.lit(False).alias("near_splice"), F.lit(False).alias("frameshift"))
    return told.unionByName(outside)


def well_formed(seq: Column, exons: Column, decays: Column, donors: tuple[str, ...], acceptors: tuple[str, ...]) -> Column:
    """struct(no_start, no_stop, ptc, bad_splice, ok) of a coding transcript on the forward strand.

    exons: array<struct<begin, end>> of the coding exons in order. A transcript that decays has a premature stop and is
    looked at no further. A missing start is pardoned if the three bases before the first exon are ATG, a missing stop if
    the last exon and the three bases after it end in one. Every inner exon end has to show one of the consensus strings.
    """
    text = F.upper(seq)
    spliced = sq.splice(text, exons)
    protein = sq.translate_codons(spliced)
    first = F.get(exons, F.lit(0))["begin"]
    last = F.get(exons, F.size(exons) - 1)["end"]
    empty = F.length(protein) < 1
    no_start = empty | (~F.startswith(protein, F.lit("M")) & ~((first > 3) & (F.substring(text, first - 2, F.lit(3)) == "ATG")))
    stop = F.instr(protein, "*")
    early = (stop > 0) & (stop < F.length(protein))
    longer = sq.translate_codons(F.concat(spliced, F.substring(text, last + 1, F.lit(3))))
    no_stop = empty | (~early & ~F.endswith(protein, F.lit("*")) & ~F.endswith(longer, F.lit("*")))
    inner = F.size(exons) - 1
    bad_donor = F.exists(F.slice(exons, 1, F.greatest(inner, F.lit(0))), lambda x: ~F.substring(text, x["end"] + 1, F.lit(2)).isin(*donors))
    bad_acceptor = F.exists(F.slice(exons, 2, F.greatest(inner, F.lit(0))), lambda x: ~F.substring(text, x["begin"] - 1, F.lit(2)).isin(*acceptors))
    decay = F.coalesce(decays, F.lit(False))
    live = lambda c: ~decay & c
    flags = [live(no_start).alias("no_start"), live(no_stop).alias("no_stop"), (decay | (~empty & early)).alias("ptc"), live(~empty & (bad_donor | bad_acceptor)).alias("bad_splice")]
    ok = ~reduce(lambda a, b: a | b, [decay, no_start, no_stop, early, bad_donor | bad_acceptor])
    return F.struct(*flags, ok.alias("ok"))


def supported_exons(exons: DataFrame, coverage: DataFrame, by: str, least: int) -> DataFrame:
    """Exons (by, begin, end) whose every base has a depth of `least` or more; coverage: by, pos, depth, absent is 0.

    Bases deep enough make maximal runs, and an exon has to lie in one, so no exon is read base by base.
    """
    deep = coverage.filter(F.col("depth") >= least).select(by, "pos").distinct()
    runs = deep.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(by).orderBy("pos"))).groupBy(by, "run").agg(F.min("pos").alias("b"), (F.max("pos") + 1).alias("e")).drop("run")
    return intervals.overlap_join(runs, exons, [by], ("b", "e"), ("begin", "end"), 1024.0, contains=True).select(*exons.columns)


def supported_introns(introns: DataFrame, junctions: DataFrame, by: str, least: int) -> DataFrame:
    """Introns with a junction of the same ends and a depth of `least` or more."""
    return introns.join(junctions.filter(F.col("depth") >= least).select(by, "begin", "end").distinct(), [by, "begin", "end"], "left_semi")


def reweight(edges: DataFrame, coverage: DataFrame, junctions: DataFrame, by: str, dna_weight: float, rna_weight: float, pseudocount: float = 1.0) -> DataFrame:
    """Edges with new scores, dna_weight * score + rna_weight * evidence, and support.

    edges: by, edge, kind (exon, intron or intergenic), begin, end, score. coverage: by, pos, share (0 to 1) for every base.
    Coding edges add up log shares, intergenic ones the logs of what is left; running sums are looked up at both ends.
    Introns take the log of their junction's depth over the deepest of their sequence, once for each base; they have support
    with any depth.
    """
    run = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = coverage.select(by, (F.col("pos") + 1).alias("pos"), F.sum(F.ln(F.col("share") + 1e-8)).over(run).alias("on"), F.sum(F.ln(1 - F.col("share") + 1e-8)).over(run).alias("off"))
    look = lambda end: sums.select(by, F.col("pos").alias(end), F.col("on").alias(f"on_{end}"), F.col("off").alias(f"off_{end}"))
    depths = junctions.groupBy(by, "begin", "end").agg(F.sum("depth").alias("depth"))
    deepest = depths.groupBy(by).agg(F.max("depth").alias("most"))
    full = edges.join(look("begin"), [by, "begin"], "left").join(look("end"), [by, "end"], "left").join(depths, [by, "begin", "end"], "left").join(deepest, by, "left")
    part = lambda c: F.coalesce(f"{c}_end", F.lit(0.0)) - F.coalesce(f"{c}_begin", F.lit(0.0))
    depth = F.coalesce("depth", F.lit(0))
    of_intron = F.ln((depth + pseudocount) / F.coalesce("most", F.lit(1))) * (F.col("end") - F.col("begin"))
    rna = F.when(F.col("kind") == "intron", of_intron).when(F.col("kind") == "exon", part("on")).otherwise(part("off"))
    return full.select(by, "edge", (F.col("score") * dna_weight + rna * rna_weight).alias("score"), ((F.col("kind") == "intron") & (depth > 0)).alias("support"))


def mapped_labels(labels: DataFrame, segments: DataFrame, by: str) -> DataFrame:
    """(by, label, begin, end): runs of labels of a reference carried over to the altered sequence by matched segments.

    labels: by, label, begin, end. segments: by, ref, alt, n of matches. Inserted bases get no label.
    """
    s = segments.select(by, F.col("ref").cast("long").alias("r0"), (F.col("ref") + F.col("n")).cast("long").alias("r1"), (F.col("alt") - F.col("ref")).alias("moved"))
    met = intervals.overlap_join(labels, s, [by], ("begin", "end"), ("r0", "r1"), 1024.0)
    return met.select(by, "label", (F.greatest("begin", "r0") + F.col("moved")).alias("begin"), (F.least("end", "r1") + F.col("moved")).alias("end"))


def composite_score(window: Column, first: Column, first_width: int, second: Column, second_width: int) -> Column:
    """The score of two matrices (maps) side by side, as of a branch point and the acceptor that follows it."""
    return sq.weight_matrix_score(window, first, first_width) + sq.weight_matrix_score(F.substring(window, F.lit(first_width + 1), F.lit(second_width)), second, second_width)


def split_by_symbols(df: DataFrame, seq: str, index: int, symbols: str) -> DataFrame:
    """Adds side: left where the character at an index is one of the symbols, else right (also past the end)."""
    there = F.substring(seq, index + 1, 1)
    return df.withColumn("side", F.when(there.isin(*symbols), "left").otherwise("right"))


def paired_sites(df: DataFrame, ident: str, seq: str, first: DataFrame, width: int, offset: int, consensus: str, second: DataFrame, ratio: DataFrame, size: int, background: DataFrame, least: int, most: int) -> DataFrame:
    """(ident, pos, strand, spacing, score): windows of one model each followed by the best window of another.

    A site is a window of `width` with the consensus at its offset, in a context that holds the longest spacing and the second
    window of `size`. Of the spacings least..most those count whose second window has a C at its second base, then A or T, and
    no G at its fourth; of them the one the ratio matrix scores highest is taken, the nearest on ties (on the other strand
    the farthest). Score: both models' windows, and the background (symbol, log_p) of all other bases of the context. A context
    with a base that a model doesn't know, or without such a spacing, is no site. pos is where the context begins on the
    forward strand.
    """
    whole = width + most + size
    # only contexts with the consensus on one of the strands are cut
    ahead = lambda w: F.substring(w, offset + 1, len(consensus)) == consensus
    behind = str.translate(consensus, str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]
    placed = sq.windows_at(F.upper(seq), "|".join({re.escape(consensus), re.escape(behind)}), [offset, whole - offset - len(consensus)], whole)
    # outer, since Spark would else work out every array twice, once to see whether it is empty
    found = df.select(ident, F.inline_outer(placed).alias("pos", "plus")).filter("pos is not null")
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("plus").alias("w")), F.struct(F.lit("-").alias("strand"), sq.reverse_complement(F.col("plus")).alias("w"))))
    sites = found.select(ident, "pos", strands.alias("s")).select(ident, "pos", "s.strand", "s.w").filter(ahead(F.col("w")))
    table = background.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "log_p"))).alias("b"))
    named = [first.select(F.col("matrix").alias("m1")), second.select(F.col("matrix").alias("m2")), ratio.select(F.col("matrix").alias("m3")), table]
    both = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), named, sites)  # four rows, as small as the models
    part = lambda d: F.substring("w", F.lit(width + 1) + d, F.lit(size))
    letter = lambda s, k: F.substring(s, k, 1)
    open_ = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda d: (letter(part(d), 2) == "C") & letter(part(d), 3).isin("A", "T") & (letter(part(d), 4) != "G"))
    near = F.when(F.col("strand") == "+", -1).otherwise(1)
    ranked = F.transform(open_, lambda d: F.struct(F.round(sq.weight_matrix_score(part(d), F.col("m3"), size), 9).alias("r"), (d * near).alias("near"), d.alias("d")))
    chosen = both.withColumn("spacing", F.array_max(F.filter(ranked, lambda x: x["r"].isNotNull()))["d"]).filter("spacing is not null")
    plain = F.concat(F.substring("w", F.lit(width + 1), F.col("spacing")), F.substring("w", F.lit(width + size + 1) + F.col("spacing"), F.lit(whole)))
    rest = F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + F.try_element_at(F.col("b"), c))
    score = sq.weight_matrix_score(F.col("w"), F.col("m1"), width) + sq.weight_matrix_score(part(F.col("spacing")), F.col("m2"), size) + rest
    return chosen.select(ident, "pos", "strand", "spacing", score.alias("score")).filter("score is not null")


def _start_score(rna: Column, at: Column, long: Column, sensor: Sensor, short: Column, width: int) -> Column:
    """Log score of a start codon at a place of a transcript: by the long model where its window fits, else by the short one,
    which begins at the codon; null where there is no start codon or no model fits."""
    codon = F.substring(rna, at + 1, F.lit(len(sensor.consensus[0])))
    begin = at - sensor.offset
    fits = (begin >= 0) & (begin + sensor.width <= F.length(rna))
    far = sq.weight_matrix_score(F.substring(rna, begin + 1, F.lit(sensor.width)), long, sensor.width)
    near = F.when(at + width <= F.length(rna), sq.weight_matrix_score(F.substring(rna, at + 1, F.lit(width)), short, width))
    return F.when((at >= 0) & codon.isin(*sensor.consensus), F.when(fits, far).otherwise(near))


def lost_upstream_orfs(df: DataFrame, ident: str, ref: str, alt: str, ref_exons: str, alt_exons: str, cigar: str, cds: str, long: DataFrame, sensor: Sensor, short: DataFrame, short_width: int) -> DataFrame:
    """(ident, ref_pos, alt_pos, ref_score, alt_score, length): start codons before the coding start that the variants undo.

    ref, alt: sequences; exons: array<struct<begin, end>> in order; cigar aligns ref to alt; cds: genomic begin of the coding
    sequence in ref. Every start codon of the spliced reference that scores the cutoff and lies before it is mapped to the
    genome, through the alignment (in a deletion to the base before) and back into the spliced alternative; it is lost if it is
    intronic there (alt_score null), no start codon any more, or scores below the cutoff. length runs to the end of the first
    stop codon in frame, or of the last whole codon. Stops are found once for each frame, so a transcript costs its length.
    """
    rows = df.select(ident, F.upper(ref).alias("__r"), F.upper(alt).alias("__a"), F.col(ref_exons).alias("rx"), F.col(alt_exons).alias("ax"), F.col(cds).alias("cds"), F.col(cigar).alias("cigar"))
    rows = rows.withColumn("rr", sq.splice(F.col("__r"), F.col("rx"))).withColumn("ar", sq.splice(F.col("__a"), F.col("ax"))).drop("__r", "__a")
    rows = rows.withColumn("stops", sq.stop_positions(F.col("rr"))).withColumn("main", sq.spliced_position(F.col("rx"), F.col("cds")))
    both = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [long.select(F.col("matrix").alias("m1")), short.select(F.col("matrix").alias("m2"))], rows)
    score = lambda rna, at: _start_score(F.col(rna), at, F.col("m1"), sensor, F.col("m2"), short_width)
    # only start codons that score unfold: a row for every place would carry the whole transcript
    codons = sq.windows_at(F.col("rr"), "|".join(map(re.escape, sensor.consensus)), [0], len(sensor.consensus[0]))
    starts = F.transform(F.filter(codons, lambda c: c["pos"] < F.col("main")), lambda c: F.struct(c["pos"].alias("at"), score("rr", c["pos"]).alias("ref_score")))
    scored = both.select("*", F.inline_outer(F.filter(starts, lambda x: x["ref_score"] >= sensor.cutoff))).filter("at is not null")

    def once(value: Column, body: Callable[[Column], Column]) -> Column:
        """body (an array) of a value that is worked out once, however often body names it."""
        return F.flatten(F.transform(F.array(value), body))

    told = lambda p, q, to: F.array(F.struct(p.alias("ref_pos"), q.alias("alt_pos"), score("ar", to).alias("alt_score")))
    there = lambda p, q: once(sq.spliced_position(F.col("ax"), q), lambda to: told(p, q, to))
    mapped = lambda seg, p: once(sq.map_position(seg, p), lambda q: there(p, q))
    places = once(sq.cigar_segments(F.col("cigar")), lambda seg: once(sq.genomic_position(F.col("rx"), F.col("at")), lambda p: mapped(seg, p)))
    new = scored.select(ident, "at", "ref_score", "rr", "stops", F.inline_outer(places))
    end = F.array_min(F.filter(F.get("stops", (F.col("at") % 3).cast("int")), lambda s: s > F.col("at")))
    length = F.coalesce(end + 3 - F.col("at"), F.floor((F.length("rr") - F.col("at")) / 3).cast("int") * 3)
    return new.filter(F.coalesce(F.col("alt_score") < sensor.cutoff, F.lit(True))).select(ident, "ref_pos", "alt_pos", "ref_score", "alt_score", length.cast("int").alias("length"))
