"""Genomic text formats as typed DataFrames: FASTA, GTF/GFF, BED, VCF, FASTQ, parenthesised reports, junction records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def attributes(text: Column, pattern: str) -> Column:
    """map<string,string> of all (key)(value) matches of a pattern with two groups; a repeated key keeps its first value."""
    return F.transform_values(attribute_lists(text, pattern), lambda _, v: F.get(v, F.lit(0)))


def attribute_lists(text: Column, pattern: str) -> Column:
    """map<string,array<string>> of all (key)(value) matches of a pattern with two groups, values in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    # the lambda's variable holds the matches, so that the text is searched once
    return F.get(F.transform(F.array(pairs), _grouped), F.lit(0))


def _grouped(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, attrs (the defline's /key=value pairs), seq; one record per row."""
    raw = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return raw.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("id"), attributes(head, r"/([^=\s]+)=(\S+)").alias("attrs"), seq.alias("seq"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """id, seq and, if there, attrs; sequences wrap at `width`."""
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" /"), e["key"], F.lit("="), e["value"])), "") if "attrs" in df.columns else F.lit("")
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), "id", attrs, F.lit("\n"), body).alias("value")).write.text(path)


GFF = "substrate string, source string, feature string, begin int, end int, score string, strand string, phase string, extra string"


def read_gff(spark: SparkSession, path: str, gff3: bool = False) -> DataFrame:
    """One feature per row, begin 0-based; attributes as a map, of a repeated key (GENCODE's tag) the first, and as a map of
    lists; GFF3's ID and Parent as transcript_id and gene_id."""
    raw = spark.read.schema(GFF).csv(path, sep="\t", comment="#", quote="")  # quotes belong to the attributes
    lists = attribute_lists(F.col("extra"), r"([^=;\s]+)=([^;]*)" if gff3 else r'([^\s;]+)\s+"?([^";]*)"?\s*;?')
    df = raw.withColumn("attr_lists", lists).withColumn("attrs", F.transform_values("attr_lists", lambda _, v: F.get(v, F.lit(0)))).withColumn("begin", F.col("begin") - 1).drop("extra")
    up = F.coalesce(F.try_element_at("attrs", F.lit("Parent")), F.try_element_at("attrs", F.lit("gene_id")))
    if gff3:
        own = F.coalesce(F.try_element_at("attrs", F.lit("ID")), F.try_element_at("attrs", F.lit("transcript_id")))
        is_part = F.col("feature").isin("exon", "CDS", "five_prime_UTR", "three_prime_UTR")
        return df.withColumn("transcript_id", F.when(is_part, up).otherwise(own)).withColumn("gene_id", up)
    return df.withColumn("transcript_id", F.try_element_at("attrs", F.lit("transcript_id"))).withColumn("gene_id", F.try_element_at("attrs", F.lit("gene_id")))


def transcripts(features: DataFrame) -> DataFrame:
    """One row per transcript with its exons (or CDS) in order of begin."""
    parts = features.filter(F.col("feature").isin("exon", "CDS"))
    exon = F.struct("begin", "end", F.col("feature").alias("kind"), "phase")
    grouped = parts.groupBy("gene_id", "transcript_id", "substrate", "strand").agg(F.array_sort(F.collect_list(exon)).alias("exons"))
    return grouped.withColumn("length", F.aggregate("exons", F.lit(0), lambda s, e: s + e["end"] - e["begin"]))


def gene_extents(features: DataFrame) -> DataFrame:
    """BED rows: the extent of every gene."""
    return features.groupBy("substrate", "gene_id").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def write_gff(df: DataFrame, path: str) -> None:
    extra = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "transcript_id", F.lit('";'))
    out = df.select("substrate", F.coalesce("source", F.lit(".")), "feature", F.col("begin") + 1, "end", F.coalesce("score", F.lit(".")), "strand", F.coalesce("phase", F.lit(".")), extra)
    out.write.csv(path, sep="\t", quote="", escape="")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3, BED4 or BED6; what is missing is null."""
    return spark.read.schema("chr string, begin int, end int, name string, score string, strand string").csv(path, sep="\t", comment="#", mode="PERMISSIVE")


def write_bed(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chr, ref_pos (0-based), id, alleles, filter, format and genotypes: array<struct<sample, gt>> in header order.

    A file's sites carry the samples of its own header. A part without one, as write_vcf leaves, takes the header that all
    others of its folder agree on; if they don't, reading such a part is an error.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"))
    own = raw.filter(F.col("value").startswith("#CHROM")).groupBy("__file").agg(F.first(F.slice(F.split("value", "\t"), 10, 1 << 20)).alias("own"))
    # one row a folder: the least header, and whether it is the only one
    folder = F.regexp_replace("__file", "/[^/]*$", "").alias("__folder")
    common = own.select(folder, "own").groupBy("__folder").agg(F.min("own").alias("least"), (F.min("own") == F.max("own")).alias("only"))
    rows = raw.filter(~F.col("value").startswith("#")).select("__file", folder, F.split("value", "\t").alias("f")).filter(F.size("f") >= 10)
    told = F.raise_error(F.concat(F.lit("no header of its own, and others differ: "), "__file")).cast("array<string>")
    body = rows.join(own, "__file", "left").join(common, "__folder", "left").withColumn("samples", F.coalesce("own", F.when(F.col("only"), F.col("least")), told))
    at = lambda k: F.get("f", F.lit(k))
    chrom = F.when(at(0).startswith("chr"), at(0)).otherwise(F.concat(F.lit("chr"), at(0)))
    pos = at(1).cast("int") - 1
    name = F.when(at(2) == ".", F.concat(chrom, F.lit("@"), (pos + 1).cast("string"))).otherwise(at(2))
    calls = F.zip_with("samples", F.slice("f", 10, 1 << 20), lambda s, g: F.struct(s.alias("sample"), g.alias("gt")))
    return body.select(
        chrom.alias("chr"), pos.alias("ref_pos"), name.alias("id"), F.concat(F.array(at(3)), F.split(at(4), ",")).alias("alleles"),
        at(6).alias("filter"), at(8).alias("format"), calls.alias("genotypes"),
    )


def write_vcf(df: DataFrame, path: str, samples: list[str]) -> None:
    """A table like read_vcf's as VCF, in range-sorted parts: in the order of their names they make one sorted file, whose
    header comes first. Genotypes are written in the order of `samples`; a sample that a site lacks is `.`."""
    gt = F.map_from_entries("genotypes")
    calls = [F.coalesce(F.try_element_at(gt, F.lit(s)), F.lit(".")) for s in samples]
    alts = F.array_join(F.slice("alleles", 2, 1 << 20), ",")
    line = F.concat_ws("\t", "chr", (F.col("ref_pos") + 1).cast("string"), "id", F.get("alleles", F.lit(0)), F.when(alts == "", ".").otherwise(alts), F.lit("."), F.coalesce("filter", F.lit(".")), F.lit("."), "format", *calls)
    body = df.select(F.lit(1).alias("k"), F.col("chr").alias("c"), F.col("ref_pos").cast("long").alias("p"), line.alias("value"))
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])
    lines = df.sparkSession.createDataFrame([(0, "", -1, "##fileformat=VCFv4.2"), (0, "", 0, head)], "k int, c string, p long, value string")
    lines.unionByName(body).orderBy("k", "c", "p").select("value").write.text(path)


#: Positions of a sequence whose sites are in one file of a folder of TVF.
REGION = 1 << 18


def write_tvf(df: DataFrame, path: str) -> None:
    """A table like read_vcf's, turned: a line of all sites `id:chr:pos:ref:alt...` in order, then one of genotypes a sample.

    The format has all of a file's sites in one line, so a file holds a region: REGION positions of one sequence. A sample
    without a site has `.` there, also where it has none in a region; one with two genotypes at a site is an error.
    """
    place = [F.col("chr"), F.col("ref_pos").cast("long").alias("ref_pos"), F.col("id")]
    by = ["chr", F.floor(F.col("ref_pos") / REGION).alias("bin")]
    sites = df.select(*place, "alleles").distinct()
    calls = df.select(*place, F.inline("genotypes").alias("sample", "gt")).groupBy("chr", "ref_pos", "id", "sample").agg(F.first("gt").alias("gt"), F.count("*").alias("n"))
    one = F.when(F.col("n") == 1, F.col("gt")).when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two genotypes at a site: "), "id", F.lit(" "), "sample")).cast("string"))
    named = F.concat_ws(":", "id", "chr", F.col("ref_pos").cast("string"), F.array_join("alleles", ":"))
    line = lambda text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ref_pos", "id", "alleles", text.alias("text")))), lambda v: v["text"]), "\t")
    head = sites.groupBy(*by).agg(line(named).alias("value")).select("chr", "bin", F.lit(0).alias("k"), F.lit("").alias("sample"), "value")
    # every sample has a line in every file, so this is no larger than what is written
    each = sites.crossJoin(calls.select("sample").distinct()).join(calls, ["chr", "ref_pos", "id", "sample"], "left")
    rows = each.groupBy(*by, "sample").agg(line(F.coalesce(one, F.lit("."))).alias("value")).select("chr", "bin", F.lit(1).alias("k"), "sample", F.concat_ws("\t", "sample", "value").alias("value"))
    lines = head.unionByName(rows).select(F.concat_ws("-", "chr", F.col("bin").cast("string")).alias("region"), "k", "sample", "value")
    lines.repartition("region").sortWithinPartitions("region", "k", "sample").select("region", "value").write.partitionBy("region").text(path)


def read_tvf(spark: SparkSession, path: str) -> DataFrame:
    """sample, chr, ref_pos, id, alleles, gt: one row for each sample and site of each file.

    Sites that aren't in order within a sequence, lines with more or fewer genotypes than there are sites, and files without a
    line of sites are errors.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file")).filter("value <> ''")
    head = F.col("value").rlike(r"^[^:\t]*:[^:\t]+:\d+:")
    fields = F.transform(F.split("value", "\t"), lambda f: F.split(f, ":"))
    site = F.transform(fields, lambda f: F.struct(F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(1)).alias("chr"), F.get(f, F.lit(2)).cast("long").alias("ref_pos"), F.slice(f, F.lit(4), F.size(f)).alias("alleles")))
    of = lambda v, c: F.transform(F.filter(v, lambda x: x["chr"] == c), lambda x: x["ref_pos"])
    ordered = F.forall(F.array_distinct(F.transform("sites", lambda v: v["chr"])), lambda c: of(F.col("sites"), c) == F.array_sort(of(F.col("sites"), c)))
    sites = raw.filter(head).select("__file", site.alias("sites")).withColumn("sites", F.when(ordered, F.col("sites")).otherwise(F.raise_error(F.lit("sites are not sorted")).cast("array<struct<id:string,chr:string,ref_pos:bigint,alleles:array<string>>>")))
    lines = raw.filter(~head).select("__file", F.split("value", "\t").alias("f"))
    calls = lines.select("__file", F.get("f", F.lit(0)).alias("sample"), F.slice("f", F.lit(2), F.size("f")).alias("gts")).join(sites, "__file", "left")
    told = F.when(F.col("sites").isNull(), F.concat(F.lit("no line of sites: "), "__file")).otherwise(F.concat(F.lit("not a genotype a site: "), "sample"))
    whole = F.when(F.size("gts") == F.size("sites"), F.arrays_zip("sites", "gts")).otherwise(F.raise_error(told))
    each = calls.select("sample", F.explode(whole).alias("c"))
    return each.select("sample", "c.sites.chr", "c.sites.ref_pos", "c.sites.id", "c.sites.alleles", F.col("c.gts").alias("gt"))


def write_indexed(df: DataFrame, path: str, chrom: str, pos: str, width: int) -> None:
    """Parquet in folders by sequence and bin of `width` positions; a bin's rows are sorted by position."""
    binned = df.withColumns({"__chr": F.col(chrom), "__bin": F.floor(F.col(pos) / width)})
    binned.withColumn("__pos", F.col(pos)).repartition("__chr", "__bin").sortWithinPartitions("__chr", "__bin", "__pos").write.partitionBy("__chr", "__bin").parquet(path)


def read_indexed(spark: SparkSession, path: str, chrom: str, begin: float, end: float, width: int) -> DataFrame:
    """The rows of [begin, end) of one sequence; other folders aren't read."""
    df = spark.read.parquet(path)
    bins = F.col("__bin").between(int(begin // width), int(end // width))
    return df.filter((F.col("__chr") == chrom) & bins & (F.col("__pos") >= begin) & (F.col("__pos") < end)).drop("__chr", "__bin", "__pos")


def write_fastq(df: DataFrame, path: str) -> None:
    """id, seq, qual as reads of four lines; no read is split between files."""
    df.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, seq, qual: every four lines of a file are a read. A quality line may begin with any character, so only the
    count of lines tells reads apart and a file is read by one task; many files are read at once."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.rtrim("value"), "\n").alias("l"))
    at = lambda k: lambda i: F.get("l", i * 4 + k)
    n = F.floor(F.size("l") / 4).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(0)(i).alias("head"), at(1)(i).alias("seq"), at(3)(i).alias("qual")))
    reads = lines.filter(n > 0).select(F.explode(rows).alias("r"))
    return reads.select(F.regexp_extract("r.head", r"^@(\S+?)(?:/[12])?(?:\s|$)", 1).alias("id"), "r.seq", "r.qual")


def pair_reads(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, only in a, only in b)."""
    pairs = a.join(b.select("id", F.col("seq").alias("mate_seq"), F.col("qual").alias("mate_qual")), "id")
    return pairs, a.join(b, "id", "left_anti"), b.join(a, "id", "left_anti")


def read_junctions(spark: SparkSession, path: str) -> DataFrame:
    """begin, end, depth, strand of binary records: two ints, a float and a character."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = [(b, e, d, s.decode()) for b, e, d, s in struct.iter_unpack("<iifc", content[: len(content) // 13 * 13])]
                yield pd.DataFrame(rows, columns=["begin", "end", "depth", "strand"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "begin int, end int, depth float, strand string")


def report_node(tag: str | Column, *children: Column) -> Column:
    """(tag child ...) as text, from children that are text already; null children are left out."""
    return F.concat(F.lit("("), F.concat_ws(" ", F.lit(tag) if isinstance(tag, str) else tag, *children), F.lit(")"))


def write_reports(df: DataFrame, path: str, report: str) -> None:
    """One report a line and record, as read_reports takes them."""
    df.select(F.concat(F.lit("#====\n"), F.col(report)).alias("value")).write.text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One parenthesised report a row, as JSON of nested arrays [tag, child, ...]."""
    import json

    from ..functions.shipping import ship
    from ..operators.splicing import trees

    ship(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [json.dumps(t) for text in pdf["value"] for t in trees(text.split("\n"))]
            yield pd.DataFrame({"tree": found}, dtype=object)

    return spark.read.text(path, lineSep="#====").mapInPandas(parse, "tree string")
