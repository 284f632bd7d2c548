"""Report analytics: status summaries, tabulation, decisions, path filters."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import with_share

OPERATORS = (">=", "<=", "!=", ">", "<", "=", "~")


def status_summary(df: DataFrame, code: str, flag: str) -> DataFrame:
    """Counts per code and per (code, flag) in one pass."""
    rolled = df.groupingSets([[F.col(code)], [F.col(code), F.col(flag)]], F.col(code), F.col(flag)).agg(F.count("*").alias("n"), F.grouping(flag).alias("g"))
    return rolled.select(code, F.when(F.col("g") == 0, F.col(flag)).alias(flag), "n")


def tabulate(df: DataFrame, by: list[str], gene: str, conditions: dict[str, Column], value: str) -> DataFrame:
    """Distinct genes per condition, and n, sum and sum of squares of a value."""
    distinct = [F.count_distinct(F.when(c, F.col(gene))).alias(name) for name, c in conditions.items()]
    return df.groupBy(*by).agg(*distinct, F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"), F.count(value).alias("n"))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key with how many there were."""
    best = F.min(F.struct(*order, *[c for c in df.columns if c not in order and c != key]))
    return df.groupBy(key).agg(best.alias("b"), F.count("*").alias("seen")).select(key, "b.*", "seen")


def path_filter(value: Column, op: str, operand: str) -> Column:
    """value OP operand: numbers compare as numbers, anything else as text; ~ is contains."""
    if op not in OPERATORS:
        raise ValueError(op)
    text = value.cast("string")
    if op == "~":
        return text.contains(operand)
    try:
        left, right = text.try_cast("double"), F.lit(float(operand))
    except ValueError:
        left, right = text, F.lit(operand)
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "=": left == right, "!=": left != right}[op]


def loss_of_function(broken: Column, nmd: Column, truncated: Column, changed: Column) -> tuple[Column, Column]:
    """(call, reason): the first of the reasons that holds."""
    reason = F.when(broken, "broken-site").when(nmd, "NMD").when(truncated, "truncation").when(changed, "protein-differs").otherwise("none")
    return F.when(broken | nmd | truncated, "loss").when(changed, "altered").otherwise("intact"), reason


def normalised_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two columns over the geometric mean of their entropies; 0 when that is no number."""
    joint = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    p = with_share(joint, "n", "p").select(a, b, "p")
    pa, pb = F.sum("p").over(Window.partitionBy(a)), F.sum("p").over(Window.partitionBy(b))
    q = p.withColumn("pa", pa).withColumn("pb", pb)
    terms = q.agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), F.sum(-F.col("p") * F.log2("pa")).alias("ha"), F.sum(-F.col("p") * F.log2("pb")).alias("hb"))
    ratio = F.col("mi") / F.nullif(F.sqrt(F.col("ha") * F.col("hb")), F.lit(0.0))
    return terms.select("mi", "ha", "hb", F.coalesce(ratio, F.lit(0.0)).alias("normalised"))


def likelihood_histogram(df: DataFrame, value: str, positive: Column, bins: int) -> DataFrame:
    """Equal-width bins over the common range: shares of positives and of all, pseudocounts 0.01 and 1, log ratio."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    counts = df.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg((F.count_if(positive) + 0.01).alias("p"), (F.count("*") + 1.0).alias("q"))
    shares = with_share(with_share(counts, "p", "ps"), "q", "qs")
    return shares.select("bin", F.col("ps").alias("p"), F.col("qs").alias("q"), F.ln(F.col("ps") / F.col("qs")).alias("log_ratio"))


def of_gene(reports: DataFrame, gene: str, value: str) -> DataFrame:
    """Reports of one gene (or substrate)."""
    return reports.filter(F.col(gene) == value)


def first_of_transcript(reports: DataFrame, transcript: str, order: str) -> DataFrame:
    """One report of each transcript, the first by order; a struct minimum combines before the shuffle."""
    rest = [c for c in reports.columns if c not in (transcript, order)]
    first = F.min(F.struct(order, *rest)).alias("__first")
    return reports.groupBy(transcript).agg(first).select(transcript, *[F.col("__first")[c].alias(c) for c in (order, *rest)]).select(*reports.columns)


def without_errors(reports: DataFrame, bad: Column, errors: str, most: int) -> DataFrame:
    """Reports whose annotation isn't bad and that list at most `most` errors; null counts are none."""
    return reports.filter(~F.coalesce(bad, F.lit(False)) & (F.coalesce(F.col(errors), F.lit(0)) <= most))


def _quoted(text: str) -> str:
    """A JSON string as a regular expression."""
    return re.escape(json.dumps(text))


def descendants(tree: Column, tag: str) -> Column:
    """How many nodes of a JSON tree, at any depth and the root included, have this name.

    A node is an array that begins with its name, as read_reports gives, or a member of an object. Quotes inside strings are
    escaped in JSON, so neither form is found within one.
    """
    return F.size(F.regexp_extract_all(tree, F.lit(rf"(\[\s*{_quoted(tag)}\s*[,\]]|{_quoted(tag)}\s*:)"), F.lit(1)))


def values_of(tree: Column, tag: str) -> Column:
    """array<string>: of all nodes [tag, value, ...] in order, the value, where it is a string."""
    found = F.regexp_extract_all(tree, F.lit(rf'\[\s*{_quoted(tag)}\s*,\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    return F.transform(found, lambda v: F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0)))


def to_tsv(reports: DataFrame, columns: list[str]) -> DataFrame:
    """(line): tab-separated values, empty for nulls, with what would break a line replaced by blanks."""
    plain = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ") for c in columns]
    return reports.select(F.concat_ws("\t", *plain).alias("line"))


def to_gff(features: DataFrame, substrate: str, source: str, feature: str, begin: str, end: str, strand: str, attrs: dict[str, str]) -> DataFrame:
    """(line): features as GFF, 1-based and closed, from 0-based half-open columns."""
    extra = F.concat_ws(" ", *[F.concat(F.lit(f'{k} "'), F.coalesce(F.col(c).cast("string"), F.lit(".")), F.lit('";')) for k, c in attrs.items()])
    fields = [F.col(substrate), F.lit(source), F.col(feature), (F.col(begin) + 1).cast("string"), F.col(end).cast("string"), F.lit("."), F.col(strand), F.lit("."), extra]
    return features.select(F.concat_ws("\t", *fields).alias("line"))


def to_xml(reports: DataFrame, tag: str, columns: list[str]) -> DataFrame:
    """(line): one XML element per report; null columns are left out."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    nodes = [F.coalesce(F.concat(F.lit(f"<{c}>"), safe(c), F.lit(f"</{c}>")), F.lit("")) for c in columns]
    return reports.select(F.concat(F.lit(f"<{tag}>"), *nodes, F.lit(f"</{tag}>")).alias("line"))
