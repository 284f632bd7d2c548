"""Column functions over sequences (strings), kept inside the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code in TCAG order (fixed values); * is a stop.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), AMINO_ACIDS, strict=True)}
#: What int(x + ROUND) adds before cutting off digits in percentages (fixed value).
ROUND = 5.0 / 9.0


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def codons(s: Column) -> Column:
    """The whole codons of s, cut in one pass: a substring by position would be searched from the start of s each time."""
    return F.regexp_extract_all(s, F.lit("(?s)(...)"), F.lit(1))


def translate_codons(s: Column) -> Column:
    """Protein of the whole codons of s; unknown codons are X."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    return F.array_join(F.transform(codons(F.upper(s)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order; an empty array for shorter strings."""
    return F.coalesce(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)), F.array().cast("array<string>"))


def windows_at(s: Column, pattern: str, shifts: list[int], width: int) -> Column:
    """array<struct<pos, window>> of the windows of `width` that begin shifts[k] before a match of a pattern of fixed length, each
    once; matches may overlap. All other windows, nearly all of them, are never cut."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    # a split before every match; only the first piece may begin without one
    begins = lambda t: F.aggregate(F.split(t, f"(?={pattern})"), start, step, lambda a: F.filter(a["out"], lambda b: (b > 0) | t.rlike(f"^(?:{pattern})")))
    fit = lambda t: F.filter(F.array_distinct(F.flatten(F.transform(begins(t), lambda b: F.array(*[b - k for k in shifts])))), lambda b: (b >= 0) & (b + width <= F.length(t)))
    cut = lambda t: F.transform(fit(t), lambda b: F.struct(b.alias("pos"), F.substring(t, b + 1, F.lit(width)).alias("window")))
    return F.get(F.transform(F.array(s), cut), F.lit(0))  # the lambda's variable holds s, so that it is worked out once


def base_fraction(s: Column, bases: str, total: str) -> Column:
    """Share of `bases` among `total` characters; null when there are none."""
    count = lambda those: F.length(s) - F.length(F.translate(s, those, ""))
    return count(bases) / F.nullif(count(total), F.lit(0))


def percent(p: Column, digits: int = 2) -> Column:
    """p as a percentage, cut the way reports cut it."""
    return F.floor(p * (100 * 10**digits) + F.lit(ROUND)) / F.lit(10.0**digits)


def masked_window(s: Column, pos: Column, flank: int, width: int) -> Column:
    """lower_SITE_lower text around a site at pos (0-based)."""
    left = F.substring(s, F.greatest(pos - flank, F.lit(0)) + 1, pos - F.greatest(pos - flank, F.lit(0)))
    return F.concat(F.lower(left), F.lit("_"), F.upper(F.substring(s, pos + 1, F.lit(width))), F.lit("_"), F.lower(F.substring(s, pos + 1 + width, F.lit(flank))))


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many leading characters a and b share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.when(differs > 0, differs - 1).otherwise(F.length(a))).cast("int")


def differing_positions(a: Column, b: Column) -> Column:
    """0-based positions at which two strings of one length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.filter(F.transform(pairs, lambda d, i: F.when(d, i).otherwise(-1)), lambda i: i >= 0)


def trim_alleles(ref: Column, alt: Column, pos: Column) -> Column:
    """struct(ref, alt, pos) after dropping the common suffix and then the common prefix."""
    suffix = common_prefix_length(F.reverse(ref), F.reverse(alt))
    r, a = F.substring(ref, F.lit(1), F.length(ref) - suffix), F.substring(alt, F.lit(1), F.length(alt) - suffix)
    prefix = common_prefix_length(r, a)
    cut = lambda s: F.substring(s, prefix + 1, F.length(s))
    return F.struct(cut(r).alias("ref"), cut(a).alias("alt"), (pos + prefix).alias("pos"))


def variant_kind(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNP").when((r < a) & (r <= 1), "INS").when((r > a) & (a <= 1), "DEL").otherwise("COMPLEX")


def weight_matrix_score(s: Column, matrix: Column, width: int) -> Column:
    """Sum over the first `width` positions of matrix['<position>:<character>']; null if a cell is missing."""
    cell = lambda i: F.try_element_at(matrix, F.concat(i.cast("string"), F.lit(":"), F.substring(s, i + 1, F.lit(1))))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell), F.lit(0.0), lambda acc, v: acc + v)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def parse_cigar(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MID])"))
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))


def cigar_segments(cigar: Column) -> Column:
    """array<struct<op, n, ref, alt>>: where each operation begins in both sequences."""
    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("alt"), F.array().cast("array<struct<op:string,n:int,ref:int,alt:int>>").alias("out"))
    step = lambda s, p: F.struct(
        (s["ref"] + F.when(p["op"] != "I", p["n"]).otherwise(0)).alias("ref"),
        (s["alt"] + F.when(p["op"] != "D", p["n"]).otherwise(0)).alias("alt"),
        F.concat(s["out"], F.array(F.struct(p["op"].alias("op"), p["n"].alias("n"), s["ref"].alias("ref"), s["alt"].alias("alt")))).alias("out"),
    )
    return F.aggregate(parse_cigar(cigar), start, step, lambda s: s["out"])


def map_position(segments: Column, pos: Column, direction: str = "left") -> Column:
    """A reference position in the altered sequence; in a deletion the nearest mapped base on that side, -1 if none."""
    matched = F.filter(segments, lambda s: s["op"] == "M")
    exact = F.filter(matched, lambda s: (s["ref"] <= pos) & (pos < s["ref"] + s["n"]))
    left = F.filter(matched, lambda s: s["ref"] + s["n"] <= pos)
    right = F.filter(matched, lambda s: s["ref"] > pos)
    inside = F.transform(exact, lambda s: s["alt"] + pos - s["ref"])
    near = F.transform(left, lambda s: s["alt"] + s["n"] - 1) if direction == "left" else F.transform(right, lambda s: s["alt"])
    return F.coalesce(F.try_element_at(inside, F.lit(1)), F.array_max(near) if direction == "left" else F.array_min(near), F.lit(-1))


def splice(seq: Column, exons: Column) -> Column:
    """Concatenation of exons, array<struct<begin, end>> (0-based, half open), of a sequence."""
    return F.array_join(F.transform(exons, lambda e: F.substring(seq, e["begin"] + 1, e["end"] - e["begin"])), "")


STOPS = ("TAA", "TAG", "TGA")


def stop_positions(s: Column) -> Column:
    """array of three arrays: where the stop codons of each frame begin, in order."""
    frame = lambda f: F.filter(F.transform(codons(F.substring(s, F.lit(f + 1), F.length(s))), lambda c, i: F.when(c.isin(*STOPS), i * 3 + f)), lambda p: p.isNotNull())
    return F.array(*[frame(f) for f in range(3)])


def spliced_position(exons: Column, pos: Column) -> Column:
    """A genomic position in the spliced exons, -1 outside them; exons: array<struct<begin, end>> in order."""
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("found"))
    step = lambda s, e: F.struct((s["at"] + e["end"] - e["begin"]).alias("at"), F.when((pos >= e["begin"]) & (pos < e["end"]), s["at"] + pos - e["begin"]).otherwise(s["found"]).alias("found"))
    return F.aggregate(exons, start, lambda s, e: step(s, e).cast("struct<at:int,found:int>"), lambda s: s["found"])


def genomic_position(exons: Column, pos: Column) -> Column:
    """A position of the spliced exons in the genome, -1 beyond them."""
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("found"))
    inside = lambda s, e: (pos >= s["at"]) & (pos < s["at"] + e["end"] - e["begin"])
    step = lambda s, e: F.struct((s["at"] + e["end"] - e["begin"]).alias("at"), F.when(inside(s, e), e["begin"] + pos - s["at"]).otherwise(s["found"]).alias("found"))
    return F.aggregate(exons, start, lambda s, e: step(s, e).cast("struct<at:int,found:int>"), lambda s: s["found"])


def first_orf(s: Column) -> Column:
    """struct(start, stop) of the first ATG, both 0-based and -1 for none; stop begins the first stop codon in frame."""
    start = F.instr(s, "ATG") - 1
    # the lambda's variable holds the codons, so that they are cut once for all three stops
    frame = F.array(codons(F.substring(s, start + 1, F.length(s))))
    first = F.get(F.transform(frame, lambda f: F.least(*[F.nullif(F.array_position(f, F.lit(c)), F.lit(0)) for c in STOPS])), F.lit(0))
    stop = F.when((start >= 0) & first.isNotNull(), start + (first - 1) * 3).otherwise(F.lit(-1)).cast("int")
    return F.struct(start.alias("start"), stop.alias("stop"))


def coding_change(ref_stop: Column, alt_stop: Column, ref_start: Column, alt_start: Column) -> Column:
    """noncoding to coding, by three rules in order, or null: no start before, a frame twice as long now, or a doubtful
    reference that has a start and no stop."""
    ref_length, alt_length = ref_stop - ref_start, alt_stop - alt_start
    has = (alt_start >= 0) & (alt_stop >= 0)
    return F.when(has & (ref_start < 0), "ref-no-start-codon").when(has & (ref_stop >= 0) & (alt_length >= 2 * ref_length), "ref-ORF-too-short").when(has & (ref_stop < 0), "possible-misannotation")
