"""What models are trained on: examples of every class cut out of annotated sequences, capped evenly, and words weighed by coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq

#: Bases before a site, and the lengths of the windows around splice sites and codons (fixed values).
BEFORE, AT_SPLICE, AT_CODON = 80, 162, 163
#: Start codons (fixed values).
STARTS = ("ATG",)
#: Groups that a class is dealt into before its cap is applied, so that no task sees a whole class.
SALTS = 64


def _piece(kind: str, begin: Column, size: Column | int, consensus: tuple[str, ...] = ()) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    wanted = F.array(*[F.lit(c) for c in consensus]) if consensus else F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("class"), begin.cast("int").alias("at"), size.cast("int").alias("size"), wanted.alias("wanted"))


def training_examples(transcripts: DataFrame, sequences: DataFrame, by: str, ident: str, donors: tuple[str, ...] = ("GT", "GC"), acceptors: tuple[str, ...] = ("AG",)) -> DataFrame:
    """(by, ident, class, strand, begin, length, seq): the examples that each transcript holds.

    transcripts: by, ident, strand, exons (array<struct<begin, end>> of the coding parts, by begin); sequences: by, seq. Classes
    are single-exon, initial-exon, internal-exon, final-exon (without start and stop codon), intron, and windows around donor,
    acceptor, start-codon and stop-codon. A sequence reads along its strand; begin is where it starts on the substrate. Of
    pieces of one class, strand, begin and length the transcript of the smallest ident stands for all. Left out are windows that
    leave the substrate or lack their consensus, pieces that hold other letters than ACGT or nothing, and transcripts that have
    an exon of fewer than three bases, no exons, or no sequence.
    """
    least, most = F.array_min(F.transform("exons", lambda e: e["begin"])), F.array_max(F.transform("exons", lambda e: e["end"]))
    fine = transcripts.filter((F.size("exons") > 0) & F.forall("exons", lambda e: e["end"] - e["begin"] >= 3))
    flank = AT_CODON - BEFORE
    spans = fine.select(by, ident, "strand", "exons", F.greatest(least - flank, F.lit(0)).alias("__from"), (most + flank).alias("__to"))
    # a transcript's own stretch is cut at the join: contigs don't travel on
    cut = spans.join(sequences.select(by, F.col("seq").alias("__seq")), by).withColumn("__to", F.least("__to", F.length("__seq")))
    local = F.upper(F.substring(F.col("__seq"), F.col("__from") + 1, F.col("__to") - F.col("__from")))
    back = F.col("strand") == "-"
    cut = cut.filter(F.element_at("exons", -1)["end"] <= F.length("__seq")).select(by, ident, "strand", "exons", "__from", "__to", F.when(back, sq.reverse_complement(local)).otherwise(local).alias("__s"))
    ahead = F.transform("exons", lambda e: F.struct((e["begin"] - F.col("__from")).alias("begin"), (e["end"] - F.col("__from")).alias("end")))
    turned = F.reverse(F.transform("exons", lambda e: F.struct((F.col("__to") - e["end"]).alias("begin"), (F.col("__to") - e["begin"]).alias("end"))))
    cut = cut.withColumn("__x", F.when(back, turned).otherwise(ahead)).withColumn("__n", F.size("__x"))

    first, last = F.element_at("__x", 1), F.element_at("__x", -1)
    inner = F.slice("__x", F.lit(2), F.greatest(F.col("__n") - 2, F.lit(0)))
    introns = F.zip_with(F.slice("__x", F.lit(1), F.col("__n") - 1), F.slice("__x", F.lit(2), F.col("__n") - 1), lambda a, b: F.struct(a["end"].alias("begin"), b["begin"].alias("end")))
    many = F.concat(
        F.array(_piece("initial-exon", first["begin"] + 3, first["end"] - first["begin"] - 3), _piece("final-exon", last["begin"], last["end"] - last["begin"] - 3)),
        F.transform(inner, lambda e: _piece("internal-exon", e["begin"], e["end"] - e["begin"])),
        F.transform(introns, lambda i: _piece("intron", i["begin"], i["end"] - i["begin"])),
        F.transform(introns, lambda i: _piece("donor", i["begin"] - BEFORE, AT_SPLICE, donors)),
        F.transform(introns, lambda i: _piece("acceptor", i["end"] - 2 - BEFORE, AT_SPLICE, acceptors)),
    )
    codons = F.array(_piece("start-codon", first["begin"] - BEFORE, AT_CODON, STARTS), _piece("stop-codon", last["end"] - 3 - BEFORE, AT_CODON, sq.STOPS))
    single = F.array(_piece("single-exon", first["begin"] + 3, first["end"] - first["begin"] - 6))
    each = cut.select(by, ident, "strand", "__from", "__to", "__s", F.explode(F.concat(F.when(F.col("__n") == 1, single).otherwise(many), codons)).alias("p"))
    inside = (F.col("p.at") >= 0) & (F.col("p.size") > 0) & (F.col("p.at") + F.col("p.size") <= F.length("__s"))
    begin = F.when(back, F.col("__to") - F.col("p.at") - F.col("p.size")).otherwise(F.col("__from") + F.col("p.at"))
    found = each.filter(inside).select(by, ident, F.col("p.class").alias("class"), "strand", begin.cast("long").alias("begin"), F.col("p.size").alias("length"), F.substring(F.col("__s"), F.col("p.at") + 1, F.col("p.size")).alias("seq"), F.col("p.wanted").alias("__wanted"))
    site = F.substring(F.col("seq"), F.lit(BEFORE + 1), F.length(F.get("__wanted", F.lit(0))))
    clean = found.filter(~F.col("seq").rlike("[^ACGT]") & ((F.size("__wanted") == 0) | F.array_contains("__wanted", site)))
    return clean.groupBy(by, "class", "strand", "begin", "length").agg(F.min(F.struct(ident, "seq")).alias("__r")).select(by, f"__r.{ident}", "class", "strand", "begin", "length", "__r.seq")


def capped(df: DataFrame, kind: str, key: list[str], caps: dict[str, int], seed: int = 1) -> DataFrame:
    """At most caps[class] rows of each class; classes without a cap stay whole. Which rows stay is told by a digest of seed and
    key, so neither order nor partitioning matters. key must tell rows apart.

    Every class is dealt into SALTS groups that are cut to the cap first; one task then sees SALTS times the cap at most.
    """
    if not caps:
        return df
    limit = F.try_element_at(F.create_map(*[x for c, n in caps.items() for x in (F.lit(c), F.lit(n))]), F.col(kind))
    rank = df.withColumn("__d", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))).withColumn("__cap", limit)
    free, held = rank.filter("__cap is null"), rank.filter("__cap is not null")
    salt = F.pmod(F.xxhash64("__d"), F.lit(SALTS))
    for by in (Window.partitionBy(kind, salt), Window.partitionBy(kind)):
        held = held.withColumn("__k", F.row_number().over(by.orderBy("__d", *key))).filter("__k <= __cap").drop("__k")
    return free.unionByName(held).drop("__d", "__cap")


def word_bias(transcripts: DataFrame, sequences: DataFrame, by: str, ident: str, k: int) -> DataFrame:
    """(word, share, biased, ratio): how much coverage prefers words of k letters.

    transcripts: by, ident, exons (array<struct<begin, end>>); sequences: by, seq, depth (array<double>, a value a base). Of
    every chunk (by) the longest transcript counts, the smallest ident on ties. share is a word's part of the spliced sequence's
    words, biased the same with each occurrence in an exon weighed by its mean depth; both are made to sum to 1 in each chunk,
    so that deep chunks don't outweigh others, then summed and made to sum to 1 over all. As in mean_kmer_weight a sequence's last
    word isn't counted. ratio is biased / share; words that only span splice sites have biased 0. Depth is taken at the
    word's place on the chunk; positions without a value have none.
    """
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda s, e: s + e["end"] - e["begin"])
    longest = transcripts.groupBy(by).agg(F.min(F.struct((-length).alias("m"), F.col(ident).alias("id"), F.col("exons").alias("exons"))).alias("t"))
    held = longest.select(by, F.col("t.exons").alias("exons")).join(sequences.select(by, "seq", "depth"), by)

    def starts(n: Column) -> Column:
        return F.when(n > k, F.sequence(F.lit(0), n - k - 1)).otherwise(F.array().cast("array<int>"))

    spliced = sq.splice(F.col("seq"), F.col("exons"))
    plain = held.select(by, spliced.alias("s")).select(by, F.explode(F.slice(sq.kmers(F.col("s"), k), F.lit(1), F.greatest(F.length("s") - k, F.lit(0)))).alias("word")).withColumns({"w": F.lit(1.0), "d": F.lit(0.0)})
    exon = held.select(by, "seq", "depth", F.explode("exons").alias("e")).select(by, "e", F.substring("seq", F.col("e.begin") + 1, F.col("e.end") - F.col("e.begin")).alias("s"), F.slice("depth", F.col("e.begin") + 1, F.greatest(F.col("e.end") - F.col("e.begin"), F.lit(0))).alias("deep"))
    placed = exon.select(by, "s", "deep", F.explode(starts(F.length("s"))).alias("i"))
    deep = F.aggregate(F.slice("deep", F.col("i") + 1, F.lit(k)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / k
    covered = placed.select(by, F.substring(F.col("s"), F.col("i") + 1, F.lit(k)).alias("word"), F.lit(0.0).alias("w"), deep.alias("d"))
    counts = plain.unionByName(covered).groupBy(by, "word").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))

    def part(x: str, over: Window) -> Column:
        whole = F.sum(x).over(over)
        return F.when(whole > 0, F.col(x) / whole).otherwise(F.lit(0.0))

    shares = counts.select("word", part("w", Window.partitionBy(by)).alias("w"), part("d", Window.partitionBy(by)).alias("d"))
    # as many rows as there are different words
    words = shares.groupBy("word").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    whole = F.broadcast(words.agg(F.nullif(F.sum("w"), F.lit(0.0)).alias("ws"), F.nullif(F.sum("d"), F.lit(0.0)).alias("ds")))  # one row
    made = words.crossJoin(whole).select("word", (F.col("w") / F.col("ws")).alias("share"), F.coalesce(F.col("d") / F.col("ds"), F.lit(0.0)).alias("biased"))
    return made.withColumn("ratio", F.col("biased") / F.nullif(F.col("share"), F.lit(0.0)))
