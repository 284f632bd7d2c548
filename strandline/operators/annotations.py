"""Annotations: biotypes, names, substrates, labels and haplotype pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.dealing import dealt


def of_biotypes(features: DataFrame, biotype: str, feature: str, kept: list[str], coding: str) -> DataFrame:
    """Features of the kept biotypes; coding transcripts are told by their CDS, so their `exon` rows go."""
    return features.filter(F.col(biotype).isin(kept) & ~((F.col(biotype) == coding) & (F.col(feature) == "exon")))


def normal_biotype(biotype: Column, coding: list[str]) -> Column:
    """Coding biotypes as they are, all others noncoding; null stays null."""
    return F.when(biotype.isin(coding), biotype).when(biotype.isNotNull(), "noncoding")


def with_prefix(name: Column, prefix: str) -> Column:
    """A substrate's name with its prefix, once."""
    return F.when(F.startswith(name, F.lit(prefix)), name).otherwise(F.concat(F.lit(prefix), name))


def slices(sequences: DataFrame, ident: str, seq: str, width: int) -> DataFrame:
    """(ident, bin, part): sequences in parts of `width`, so that a region's read touches only its own parts."""
    at = F.posexplode(F.regexp_extract_all(F.col(seq), F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1)))
    return sequences.select(ident, at.alias("bin", "part"))


def read_regions(parts: DataFrame, regions: DataFrame, ident: str, begin: str, end: str, width: int) -> DataFrame:
    """(region columns, seq): [begin, end) of a sliced sequence, cut at its end; regions meet only the bins they touch."""
    last = F.greatest(F.floor((F.col(end) - 1) / width), F.floor(F.col(begin) / width))
    asked = regions.withColumn("bin", F.explode(F.sequence(F.floor(F.col(begin) / width).cast("int"), last.cast("int"))))
    got = asked.join(parts, [ident, "bin"])
    piece = F.struct("bin", F.substring("part", F.greatest(F.col(begin) - F.col("bin") * width, F.lit(0)) + 1, F.least(F.col(end) - F.col("bin") * width, F.lit(width)) - F.greatest(F.col(begin) - F.col("bin") * width, F.lit(0))).alias("s"))
    return got.groupBy(*regions.columns).agg(F.array_join(F.array_sort(F.collect_list(piece))["s"], "").alias("seq"))


def differing_runs(df: DataFrame, ident: str, a: str, b: str) -> DataFrame:
    """(ident, begin, end): maximal runs of consecutive positions at which two strings differ."""
    at = df.select(ident, F.posexplode(sq.differing_positions(F.col(a), F.col(b))).alias("nth", "pos"))
    return at.groupBy(ident, (F.col("pos") - F.col("nth")).alias("run")).agg(F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end")).drop("run")


def tile(parts: DataFrame, by: str, begin: str, end: str) -> DataFrame:
    """(by, kind, begin, end): the parts of each transcript by ordinal (single, initial, internal, final) and the introns
    between them, one contiguous row of regions. Transcripts are dealt out once and sorted once."""
    order = Window.partitionBy(by).orderBy(begin, end)
    lines = dealt(parts.select(by, begin, end), by)
    numbered = lines.select(by, begin, end, F.lag(F.lit(1)).over(order).alias("before"), F.lead(F.lit(1)).over(order).alias("after"), F.lead(begin).over(order).alias("next"))
    first, last = F.col("before").isNull(), F.col("after").isNull()
    kind = F.when(first & last, "single-exon").when(first, "initial-exon").when(last, "final-exon").otherwise("internal-exon")
    exon = F.struct(kind.alias("kind"), F.col(begin).alias("begin"), F.col(end).alias("end"))
    intron = F.when(F.col("next") > F.col(end), F.struct(F.lit("intron").alias("kind"), F.col(end).alias("begin"), F.col("next").alias("end")))
    return numbered.select(by, F.inline(F.array_compact(F.array(exon, intron))))


#: Length of a start or stop codon and of a splice site's consensus (fixed values).
CODON, SITE = 3, 2


def flanking_signals(exons: DataFrame, keep: list[str], kind: str, begin: str, end: str, strand: str, offsets: dict[str, int] | None = None) -> DataFrame:
    """(keep, signal, pos, window): the two signals that bound each coding exon.

    kind: initial-exon, internal-exon, final-exon or single-exon; other kinds make none. On the reverse strand signals are
    named NEG_ and the exon's ends change roles. window is where a sensor's context begins that has its consensus
    offsets[signal] bases on (0 where not given).
    """
    forward = F.col(strand) == "+"
    starts, stops = F.col(kind).isin("initial-exon", "single-exon"), F.col(kind).isin("final-exon", "single-exon")
    b, e = F.col(begin), F.col(end)
    opens = F.when(forward, F.when(starts, "ATG").otherwise("AG")).otherwise(F.when(stops, "NEG_TAG").otherwise("NEG_GT"))
    closes = F.when(forward, F.when(stops, "TAG").otherwise("GT")).otherwise(F.when(starts, "NEG_ATG").otherwise("NEG_AG"))
    # codons belong to the exon, splice sites to the intron beside it
    left = F.struct(opens.alias("signal"), F.when(opens.isin("ATG", "NEG_TAG"), b).otherwise(b - SITE).alias("pos"))
    right = F.struct(closes.alias("signal"), F.when(closes.isin("TAG", "NEG_ATG"), e - CODON).otherwise(e).alias("pos"))
    known = exons.filter(F.col(kind).isin("initial-exon", "internal-exon", "final-exon", "single-exon"))
    rows = known.select(*keep, F.inline(F.array(left, right)))
    shift = F.lit(0)
    for name, by in (offsets or {}).items():
        shift = F.when(F.col("signal") == name, by).otherwise(shift)
    return rows.withColumn("window", F.col("pos") - shift)


def linkage(first: DataFrame, second: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """n, d and r2 of two genes' alleles (0 or 1) that share an individual and a haplotype."""
    both = first.select(*on, F.col(a).cast("double").alias("a")).join(second.select(*on, F.col(b).cast("double").alias("b")), on)
    t = both.agg(F.count("*").alias("n"), F.avg("a").alias("pa"), F.avg("b").alias("pb"), F.avg(F.col("a") * F.col("b")).alias("pab"))
    d = F.col("pab") - F.col("pa") * F.col("pb")
    spread = F.col("pa") * (1 - F.col("pa")) * F.col("pb") * (1 - F.col("pb"))
    return t.select("n", d.alias("d"), (d * d / F.nullif(spread, F.lit(0.0))).alias("r2"))


def labels_of(runs: DataFrame, label: str, length: str, *keep: str) -> DataFrame:
    """One row per base of a run-length table, as label files hold them; runs without a length make none."""
    return runs.filter(F.col(length) > 0).select(*keep, F.col(label).alias("label"), F.explode(F.sequence(F.lit(0), F.col(length) - 1)).alias("offset"))


def same_sequences(a: DataFrame, b: DataFrame, ordinal: str, seq: str) -> DataFrame:
    """identical: whether two sets hold the same sequences in the same order, names aside."""
    left, right = a.select(F.col(ordinal).alias("o"), F.col(seq).alias("s")), b.select(F.col(ordinal).alias("o"), F.col(seq).alias("t"))
    both = left.withColumn("l", F.lit(True)).join(right.withColumn("r", F.lit(True)), "o", "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.col("s").eqNullSafe(F.col("t")) & F.coalesce("l", F.lit(False)) & F.coalesce("r", F.lit(False))), F.lit(True)).alias("identical"))
