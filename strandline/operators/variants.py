"""Variants: site filters, genotypes in long form, major alleles, haplotype construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from . import intervals


def is_dna(alleles: Column) -> Column:
    """Whether the reference and every alternative are plain DNA."""
    return F.forall(alleles, lambda a: a.rlike("^[ACGTacgt]+$"))


def usable_site(alleles: Column, flt: Column, fmt: Column, strict: bool = False) -> Column:
    """PASS (or no filter, unless strict), genotypes alone, and plain DNA alleles; strict sites have one alternative."""
    passed = flt == "PASS" if strict else flt.isin("PASS", ".")
    return passed & (fmt == "GT") & is_dna(alleles) & ((F.size(alleles) == 2) if strict else F.lit(True))


def is_snp(alleles: Column) -> Column:
    return F.forall(alleles, lambda a: F.length(a) == 1)


def long_genotypes(vcf: DataFrame) -> DataFrame:
    """(chr, ref_pos, id, alleles, sample, hap, allele), one row per haplotype; unphased and missing calls are null."""
    calls = vcf.select("chr", "ref_pos", "id", "alleles", F.explode("genotypes").alias("g"))
    return calls.select("chr", "ref_pos", "id", "alleles", F.col("g.sample").alias("sample"), F.posexplode(F.split(F.col("g.gt"), r"[|/]")).alias("hap", "a")).select("chr", "ref_pos", "id", "alleles", "sample", "hap", F.col("a").try_cast("int").alias("allele"))


def major_alleles(genotypes: DataFrame, populations: DataFrame) -> DataFrame:
    """Per site and population the most frequent allele, the lowest on ties; samples without population are left out."""
    known = genotypes.filter("allele is not null").join(populations, "sample")
    counts = known.groupBy("chr", "ref_pos", "id", "population", "allele").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("allele").alias("allele")))
    return counts.groupBy("chr", "ref_pos", "id", "population").agg(best.alias("b")).select("chr", "ref_pos", "id", "population", F.col("b.allele").alias("major"), (-F.col("b.m")).alias("n"))


def haplotype_ploidy(chrom: Column, male: Column) -> Column:
    """2, but 1 for a male's X and Y, and 0 for the Y of anyone else."""
    return F.when(chrom == "chrY", F.when(male, 1).otherwise(0)).when((chrom == "chrX") & male, 1).otherwise(2)


def chosen_variants(edits: DataFrame, by: list[str]) -> DataFrame:
    """Of every closure of overlapping edits (ref_pos, ref, alt) the longest by reference, then by alternative, then the
    first; with the number passed over as `dropped`."""
    spans = edits.withColumn("__end", F.col("ref_pos") + F.greatest(F.length("ref"), F.lit(1)) - 1)
    grouped = intervals.with_island(spans, by, "ref_pos", "__end", "ref_pos")
    order = Window.partitionBy(*by, "island").orderBy(F.desc(F.length("ref")), F.desc(F.length("alt")), "ref_pos", "alt")
    ranked = grouped.withColumn("__k", F.row_number().over(order)).withColumn("dropped", F.count("*").over(Window.partitionBy(*by, "island")) - 1)
    return ranked.filter("__k = 1").drop("__k", "__end", "island")


def build_haplotypes(regions: DataFrame, edits: DataFrame, by: list[str]) -> DataFrame:
    """regions (by, seq) with edits (by, ref_pos, ref, alt) applied: hap_seq, cigar, applied, mismatched.

    An edit whose reference bases differ from the sequence isn't applied and counts as mismatched.
    """
    picked = chosen_variants(edits, by)
    listed = picked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ref_pos", "ref", "alt"))).alias("edits"))
    base = regions.join(listed, by, "left").withColumn("edits", F.coalesce("edits", F.array().cast("array<struct<ref_pos:int,ref:string,alt:string>>")))
    # in bytes a piece is cut where it lies; in text it would be searched from the start for each edit
    base = base.withColumn("__b", F.col("seq").cast("binary"))
    cut = lambda at, n: F.substring(F.col("__b"), at + 1, n).cast("string")
    fits = lambda e: cut(e["ref_pos"], F.length(e["ref"])) == e["ref"]
    base = base.withColumn("ok", F.filter("edits", fits)).withColumn("mismatched", F.size("edits") - F.size("ok"))
    done = base.withColumn("at", F.concat(F.array(F.lit(0)), F.transform("ok", lambda e: e["ref_pos"] + F.length(e["ref"]))))

    def op(n: Column, letter: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(letter))).otherwise("")

    def letters(e: Column, at: Column) -> Column:
        r, a = F.length(e["ref"]), F.length(e["alt"])
        both = F.least(r, a)
        return F.concat(op(e["ref_pos"] - at, "M"), op(both, "M"), op(a - both, "I"), op(r - both, "D"))

    # every edit makes its own piece, joined once at the end; `at` has one value more, where the rest begins
    ends, last = F.slice("at", F.lit(1), F.size("ok")), F.element_at("at", -1)
    pieces = F.zip_with("ok", ends, lambda e, at: F.concat(cut(at, e["ref_pos"] - at), e["alt"]))
    rest = F.length("__b") - last
    whole = F.concat(F.array_join(pieces, ""), cut(last, F.greatest(rest, F.lit(0))))
    cigar = F.concat(F.array_join(F.zip_with("ok", ends, letters), ""), op(rest, "M"))
    return done.select(*by, whole.alias("hap_seq"), cigar.alias("cigar"), F.size("ok").alias("applied"), "mismatched")


def map_exons(transcripts: DataFrame, cigar: str) -> DataFrame:
    """Exons through a CIGAR by their splice sites: two bases before the begin, and the end itself."""
    df = transcripts.withColumn("__s", sq.cigar_segments(F.col(cigar)))
    mapped = F.transform("exons", lambda e: F.struct((sq.map_position(F.col("__s"), e["begin"] - 2) + 2).alias("begin"), sq.map_position(F.col("__s"), e["end"]).alias("end")))
    return df.withColumn("mapped", mapped).drop("__s")


def major_genomes(regions: DataFrame, genotypes: DataFrame, populations: DataFrame) -> DataFrame:
    """Per population the regions (chr, seq) with its major alleles in place: chr, population, hap_seq, cigar, applied, mismatched.

    genotypes as of long_genotypes. A population whose major alleles are all the reference's gets the sequence as it is.
    """
    major = major_alleles(genotypes, populations)
    sites = genotypes.groupBy("chr", "ref_pos", "id").agg(F.first("alleles").alias("alleles"))
    edits = major.filter("major > 0").join(sites, ["chr", "ref_pos", "id"])
    edits = edits.select("chr", "population", "ref_pos", F.get("alleles", F.lit(0)).alias("ref"), F.get("alleles", F.col("major")).alias("alt"))
    each = regions.join(major.select("chr", "population").distinct(), "chr")
    return build_haplotypes(each, edits, ["chr", "population"])


def individual_genomes(genes: DataFrame, sequences: DataFrame, genotypes: DataFrame, margin: int, width: float = 4096.0) -> DataFrame:
    """gene, sample, hap, chr, begin, end, hap_seq, cigar, applied, mismatched: each gene with `margin` bases around it, as each haplotype
    of each individual has it.

    genes: gene, chr, begin, end; sequences: chr, seq; genotypes as of long_genotypes. Stretches end where their chromosome does.
    An edit counts where all of its reference bases lie in the stretch. An individual with genotypes on the chromosome but
    none in the stretch has the sequence as it is; genes on chromosomes without a sequence are left out.
    """
    # lengths first, so that sequences join once, when the stretches are known
    known = genes.join(sequences.select("chr", F.length("seq").cast("long").alias("__n")), "chr")
    spans = known.select("gene", "chr", F.greatest(F.col("begin") - margin, F.lit(0)).cast("long").alias("__begin"), F.least(F.col("end") + margin, F.col("__n")).cast("long").alias("__end"))
    stretch = F.substring(F.col("seq"), (F.col("__begin") + 1).cast("int"), (F.col("__end") - F.col("__begin")).cast("int"))
    cut = spans.join(sequences.select("chr", "seq"), "chr").select("gene", "chr", "__begin", "__end", stretch.alias("seq"))
    people = genotypes.select("chr", "sample", "hap").distinct()
    by = ["gene", "sample", "hap"]
    changed = genotypes.filter("allele > 0").select("chr", F.col("ref_pos").cast("long").alias("ref_pos"), "sample", "hap", F.get("alleles", F.lit(0)).alias("ref"), F.get("alleles", F.col("allele")).alias("alt"))
    found = intervals.point_in_region(changed, spans, "ref_pos", "__begin", "__end", width, ["chr"])
    edits = found.filter(F.col("ref_pos") + F.length("ref") <= F.col("__end")).select(*by, (F.col("ref_pos") - F.col("__begin")).cast("int").alias("ref_pos"), "ref", "alt")
    made = build_haplotypes(cut.join(people, "chr").select(*by, "seq"), edits, by)
    return made.join(spans, "gene").select(*by, "chr", F.col("__begin").alias("begin"), F.col("__end").alias("end"), "hap_seq", "cigar", "applied", "mismatched")
