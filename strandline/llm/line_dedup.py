"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Every text splits into lines at line feeds; lines of white space alone are left alone. A line's set is its distinct strings
of SHINGLE characters (the line itself if it is shorter). Signatures are one-permutation MinHash: each string is hashed
once, inside generated code, and falls into one of BINS bins by its low bits; a bin's value is the least hash there. Long
lines only aggregate hashes below a bound that about PER_BIN strings of each bin pass, and those of their first ALWAYS strings,
which hold all there is of lines that repeat a few words; an empty bin takes the value of the
next one. The minima are aggregated per different line in the scan, before anything is shuffled. BANDS bands of ROWS bins
make groups of lines; a pair that meets in a group is verified by the exact Jaccard similarity of its sets if at least AGREE
bins agree, and linked lines join by distributed union-find. Groups are resolved by pivots (jaccard_join.link_groups): a
family's lines are mostly connected by their pairs with the pivot, a number that grows with the lines and not with the square
of a family, and texts are only fetched for these and for what is open then. Of each component the first line stays, by doc_id (null last), line number and row.

Two lines link at Jaccard similarity PER_HUNDRED / 100 or more. Bands and agreement find about 95 % of the pairs of exactly
that similarity and nearly all of higher ones (tests measure it). A null text has no lines. The lines of a repeated
row are lines like any others. Extra columns are left alone.
"""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read, tidy
from .jaccard_join import link_groups

SHINGLE = 5
BINS, PER_BIN, ALWAYS = 16, 4, 16
BANDS, ROWS, AGREE = 12, 4, 9
PER_HUNDRED = 80
#: Every group takes one pivot. Groups that it leaves unsettled compare the marks of all pairs of different components if these
#: are at most AT_ONCE, or PAIRS_A_LINE a line, altogether; else those of up to MOST lines do, and larger ones take more pivots.
MOST, AT_ONCE, PAIRS_A_LINE = 256, 1 << 22, 64
#: Lines of a large group that meet all of it in one part.
PART = 1024
#: White space that alone makes no line (fixed values).
BLANK = " \t\x0b\x0c\r"


def _bands() -> list[list[int]]:
    """BANDS sets of ROWS bins, dealt evenly from shuffled decks of all bins."""
    rng, deck, out = random.Random(1), [], []
    for _ in range(BANDS):
        if len(deck) < ROWS:
            deck += rng.sample(range(BINS), BINS)
        out.append(sorted(set(deck[:ROWS])))
        deck = deck[ROWS:]
    return out


def _lines(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """keep, line_no, line, and two hashes that stand for the line, for all lines that aren't blank."""
    split = F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    lines = docs.select(*keep, split.alias("line_no", "line")).filter(F.btrim("line", F.lit(BLANK)) != "")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def signatures(lines: DataFrame) -> DataFrame:
    """h1, h2, and m0 .. of every different line of lines (h1, h2, line)."""
    # four bytes a character, so that a string is cut without a search for its place
    wide = lines.select("h1", "h2", F.encode("line", "UTF-32").alias("u"))
    bound = (F.lit(PER_BIN * BINS * 4.0) / F.length("u") * F.lit(2.0**31)).cast("long")
    each = F.explode(F.sequence(F.lit(0), F.greatest(F.length("u") - 4 * SHINGLE, F.lit(0)), F.lit(4)))
    strings = wide.select("h1", "h2", "u", bound.alias("bound"), each.alias("at"))
    hashes = strings.select("h1", "h2", "bound", "at", F.xxhash64(F.substring("u", F.col("at") + 1, F.lit(4 * SHINGLE))).alias("h"))
    kept = hashes.filter((F.shiftrightunsigned("h", 33) < F.col("bound")) | (F.col("at") < 4 * ALWAYS))
    value = F.shiftrightunsigned("h", 33).cast("int")
    least = [F.min(F.when(F.col("h").bitwiseAND(F.lit(BINS - 1)) == k, value)).alias(f"m{k}") for k in range(BINS)]
    out, step = kept.groupBy("h1", "h2").agg(*least), 1
    while step < BINS:
        out = out.select("h1", "h2", *[F.coalesce(f"m{k}", f"m{(k + step) % BINS}").alias(f"m{k}") for k in range(BINS)])
        step *= 2
    return out


def strings_of(line: str = "line") -> Column:
    """The set of a line."""
    all_of = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(F.array_distinct(all_of))


def packed(signed: DataFrame) -> DataFrame:
    """h1, h2, node, and the low bytes of the minima in two longs, an eighth of their size in rows. Bytes of different minima
    agree once in 256, which only adds to what is verified."""
    byte = lambda k: F.shiftleft(F.col(f"m{k}").bitwiseAND(F.lit(255)).cast("long"), 8 * (k % 8))
    half = lambda of: reduce(lambda a, b: a.bitwiseOR(b), [byte(k) for k in of])
    return signed.select("h1", "h2", half(range(8)).alias("s0"), half(range(8, BINS)).alias("s1"), F.monotonically_increasing_id().alias("node"))


def _byte(word: Column, k: int) -> Column:
    return F.shiftrightunsigned(word, 8 * (k % 8)).bitwiseAND(F.lit(255))


def _agree() -> Column:
    """Whether the marks x0, x1 and p0, p1 agree in AGREE bins or more."""
    differs = [F.col(f"x{j}").bitwiseXOR(F.col(f"p{j}")) for j in range(2)]
    return reduce(lambda a, b: a + b, [F.when(_byte(differs[k // 8], k) == 0, 1).otherwise(0) for k in range(BINS)]) >= AGREE


def alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (x, p) whose signatures agree in AGREE bins or more."""
    side = lambda c: signed.select(F.col("node").alias(c), F.col("s0").alias(f"{c}0"), F.col("s1").alias(f"{c}1"))
    return pairs.join(side("x"), "x").join(side("p"), "p").filter(_agree()).select("x", "p")


def alike_within(groups: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (x, p) of different roots inside groups (g, x, root, size) whose signatures agree. Marks travel with the
    members, so that pairs are judged where they meet; a large group's members are dealt out, each part meets all of it."""
    known = groups.join(signed.select(F.col("node").alias("x"), "s0", "s1"), "x")
    parts = F.floor(F.col("size") / PART).cast("int")
    mine = known.select("g", F.pmod(F.hash("x"), parts + 1).alias("part"), "x", "root", F.col("s0").alias("x0"), F.col("s1").alias("x1"))
    other = known.select("g", F.explode(F.sequence(F.lit(0), parts)).alias("part"), F.col("x").alias("p"), F.col("root").alias("root_p"), F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    met = mine.hint("shuffle_merge").join(other, ["g", "part"])
    return met.filter((F.col("x") < F.col("p")) & (F.col("root") != F.col("root_p")) & _agree()).select("x", "p").distinct()


def texts_of(docs: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of the wanted nodes. Copies of a line meet where the join has put them, so that lines move once."""
    wanted = signed.select("h1", "h2", "node").join(nodes, "node")
    found = _lines(docs).select("h1", "h2", "line").join(wanted, ["h1", "h2"])
    return found.groupBy("h1", "h2").agg(F.first("node").alias("node"), F.first("line").alias("line")).select("node", "line")


def distances(pairs: DataFrame, texts: DataFrame, ws: Workspace, parts: int = 1) -> DataFrame:
    """(x, p, linked, d) of pairs of nodes; d is exact. Lines travel, not their sets, which are ten times as large, and only
    those of one of `parts` parts of the pairs at a time.

    Written at once: a filter on what is not would move below the sets and build them anew for every use.
    """
    side = lambda c: texts.select(F.col("node").alias(c), F.col("line").alias(f"line_{c}"))
    both = F.size(F.array_intersect("of_x", "of_p")).alias("both")
    union = F.col("sizes") - F.col("both")
    linked, d = (100 * F.col("both") >= PER_HUNDRED * union).alias("linked"), (1 - F.col("both") / union).alias("d")

    def measured(part: DataFrame) -> DataFrame:
        sets = part.join(side("x"), "x").join(side("p"), "p").select("x", "p", strings_of("line_x").alias("of_x"), strings_of("line_p").alias("of_p"))
        full = sets.select("x", "p", both, (F.size("of_x") + F.size("of_p")).alias("sizes"))
        return full.select("x", "p", linked, d)

    if parts <= 1:
        return ws.put(measured(pairs), "distances")
    return ws.put_each((measured(pairs.filter(F.pmod(F.xxhash64("x", F.lit(3)), F.lit(parts)) == k)) for k in range(parts)), "distances")


def fuzzy_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, kept for every line of docs (doc_id, text) that isn't blank."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    signed = ws.put(packed(signatures(_lines(docs))), "signatures")
    tidy(spark)
    groups = F.explode(F.array(*[F.xxhash64(F.lit(b), *[_byte(F.col(f"s{k // 8}"), k) for k in bins]) for b, bins in enumerate(_bands())]))
    # one shuffle serves the counts and the join: both sides read the same columns of it
    members = signed.select(groups.alias("g"), F.col("node").alias("x")).repartition("g")
    often = members.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low < high").select("g")
    members = ws.put(members.join(often, "g").select("g", "x"), "members")
    tidy(spark)

    lines = signed.count()
    at_once = max(AT_ONCE, PAIRS_A_LINE * lines)

    def measure(pairs: DataFrame) -> DataFrame:
        """Distances of the pairs (x, p) whose signatures agree; their texts are searched once they are known."""
        near = ws.put(pairs, "near")
        tidy(spark)
        texts = ws.put(texts_of(docs, signed, near.select(F.explode(F.array("x", "p")).alias("node")).distinct()), "texts")
        tidy(spark)
        out = distances(near, texts, ws, math.ceil(near.count() / max(1, lines)))
        ws.drop(near, texts)
        tidy(spark)
        return out

    roots = link_groups(members, ws, lambda pairs, cap: measure(alike(pairs, signed)), lambda groups, r: measure(alike_within(groups, signed)), PER_HUNDRED, MOST, at_once)
    ws.drop(members)

    places = ws.put(_lines(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "line_no", "h1", "h2").withColumn("place", F.monotonically_increasing_id()), "places")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "place")).alias("first")
    classes = places.groupBy("h1", "h2").agg(first).join(signed.select("h1", "h2", "node"), ["h1", "h2"])
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = ws.put(rooted.select("h1", "h2", "root", "first"), "rooted")
    ws.drop(signed)
    tidy(spark)
    kept = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    named = rooted.join(kept, "root").select("h1", "h2", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), F.col("keep.place").alias("keep_place"))
    return places.join(named, ["h1", "h2"]).select("doc_id", "line_no", "keep_doc_id", "keep_line_no", (F.col("place") == F.col("keep_place")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_line_dedup(read(spark, sf_dir, "documents"))
