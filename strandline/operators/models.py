"""Sequence models as tables: k-mer statistics, position weights, Markov chains with back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.dealing import dealt, parts_for


def kmer_counts(df: DataFrame, seq: Column, k: int, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.select(*by, F.explode(sq.kmers(seq, k)).alias("kmer")).groupBy(*by, "kmer").agg(F.count("*").alias("n"))


#: k-mers with a weight up to which they are sent to the sequences, instead of every k-mer of these to its weight.
SENT_KMERS = 1 << 18


def mean_kmer_weight(df: DataFrame, ident: str, seq: Column, k: int, weights: DataFrame) -> DataFrame:
    """Mean weight of a sequence's k-mers but for the last one: the sum over L - k of them.

    Sequences are dealt out by ident before they unfold, so that their k-mers are summed where they are cut.
    """
    rows = dealt(df.select(ident, seq.alias("__s")), ident)
    found = rows.select(ident, F.explode(F.slice(sq.kmers(F.col("__s"), k), 1, F.greatest(F.length("__s") - k, F.lit(0)))).alias("kmer"))
    few = weights.count() <= SENT_KMERS
    per = found.join(F.broadcast(weights) if few else weights, "kmer", "left")
    return per.groupBy(ident).agg((F.sum(F.coalesce("weight", F.lit(0.0))) / F.count("*")).alias("mean_weight"))


def entropy_by_order(df: DataFrame, ident: list[str], seq: Column, order: int) -> DataFrame:
    """Entropy in bits of a character given the `order` before it, per ident: H(k + 1) - H(k)."""

    def block(k: int, name: str) -> DataFrame:
        counts = kmer_counts(df, seq, k, ident)
        total = F.sum("n").over(Window.partitionBy(*ident))
        p = F.col("n") / total
        return counts.withColumn("h", -p * F.log2(p)).groupBy(*ident).agg(F.sum("h").alias(name))

    if order == 0:
        return block(1, "entropy")
    return block(order + 1, "a").join(block(order, "b"), ident).select(*ident, (F.col("a") - F.col("b")).alias("entropy"))


def train_weight_matrix(df: DataFrame, seq: Column, width: int, alphabet: str, weight: Column | None = None, pseudocount: float = 1.0) -> DataFrame:
    """ln of the weighted share of each symbol at each position, with pseudocounts: (pos, symbol, log_p)."""
    w = F.lit(1.0) if weight is None else weight
    cells = df.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.substring(seq, i, F.lit(1)))).alias("pos", "symbol"), w.alias("w"))
    counts = cells.groupBy("pos", "symbol").agg(F.sum("w").alias("n"))
    # the grid is width x alphabet, whatever the data
    grid = df.sparkSession.range(width).select(F.col("id").cast("int").alias("pos"), F.explode(F.array(*[F.lit(c) for c in alphabet])).alias("symbol"))
    full = grid.join(counts, ["pos", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + pseudocount)
    return full.select("pos", "symbol", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("pos"))).alias("log_p"))


def matrix_map(matrix: DataFrame) -> DataFrame:
    """One row with the matrix as a map '<pos>:<symbol>' -> log_p; as small as the matrix."""
    entries = F.collect_list(F.struct(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("symbol")), "log_p"))
    return matrix.agg(F.map_from_entries(entries).alias("matrix"))


def backoff_score(df: DataFrame, ident: str, seq: Column, least: int) -> DataFrame:
    """Mean log probability of each character given the one before; pairs seen less than `least` times back off to the
    character alone. Trained on the same sequences.

    Pairs are counted within tasks first; the model, at most the alphabet's square, goes to the sequences as one row, so that
    these are summed a row at a time and only their sums are dealt out by ident.
    """
    chars = df.select(ident, sq.kmers(seq, 1).alias("__c"))
    pairs = F.transform("__c", lambda c, i: F.struct(F.when(i > 0, F.get("__c", i - 1)).alias("before"), c.alias("c")))
    n = chars.select(F.inline(pairs)).groupBy("before", "c").agg(F.count("*").alias("n2"))
    one = with_share(n.groupBy("c").agg(F.sum("n2").alias("n1")), "n1", "p1").select("c", "p1")
    two = n.filter("before is not null").withColumn("p2", F.col("n2") / F.sum("n2").over(Window.partitionBy("before")))
    ln_p = F.ln(F.when(F.col("n2") >= least, F.col("p2")).otherwise(F.col("p1")))
    cells = two.join(one, "c").select("before", "c", ln_p.alias("p")).unionByName(one.select(F.lit("").alias("before"), "c", F.ln("p1").alias("p")))
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    model = cells.groupBy("before").agg(entries("c", "p").alias("m")).agg(entries("before", "m").alias("model"))
    cost = lambda c, i: F.try_element_at(F.try_element_at("model", F.when(i > 0, F.get("__c", i - 1)).otherwise("")), c)
    summed = F.aggregate(F.transform("__c", cost), F.lit(0.0), lambda acc, v: acc + v)
    rows = chars.filter(F.size("__c") > 0).crossJoin(F.broadcast(model)).select(ident, summed.alias("s"), F.size("__c").alias("k"))
    return rows.repartition(parts_for(df), ident).groupBy(ident).agg((F.sum("s") / F.sum("k")).alias("score"))


def with_share(df: DataFrame, n: str, name: str) -> DataFrame:
    """Adds n over its total: one aggregated row joined back, so that no window gathers all rows in one task."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(n).alias("__all")))).withColumn(name, F.col(n) / F.col("__all")).drop("__all")


def relative_entropy(counts: DataFrame, group: str, a: str, b: str, pseudocount: float = 1.0) -> DataFrame:
    """Sum of p ln(p / q) over all k-mers that either group has, with pseudocounts."""
    wide = counts.filter(F.col(group).isin(a, b)).groupBy("kmer").agg(*[(F.coalesce(F.sum(F.when(F.col(group) == g, F.col("n"))), F.lit(0)) + pseudocount).alias(x) for x, g in (("x", a), ("y", b))])
    wide = with_share(with_share(wide, "x", "p"), "y", "q")
    p, q = F.col("p"), F.col("q")
    return wide.select((p * F.ln(p / q)).alias("t"), p.alias("p")).agg(F.sum("t").alias("relative_entropy"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """The contingency statistic of two label columns and its degrees of freedom."""
    joint = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    joint = joint.crossJoin(F.broadcast(joint.agg(F.sum("n").alias("all"))))  # one row
    ra, rb, n = F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b)), F.col("all")
    cells = joint.select(a, b, "n", (ra * rb / n).alias("e"), n.alias("total"))
    # cells never seen add their expectation; summed, all expectations make the total
    return cells.agg((F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")) + F.max("total") - F.sum("e")).alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))


def weight_array(df: DataFrame, seq: Column, width: int, pseudocount: float = 1.0, pooled: int = 0) -> DataFrame:
    """(pos, before, c, logp): log probability of a character given the one before, per position of aligned sequences
    (`before` is empty at the first). With `pooled`, positions up to that far off are counted too. Smoothed over the
    characters seen anywhere."""
    chars = df.select(F.posexplode(F.slice(sq.kmers(seq, 1), 1, width)).alias("pos", "c"), seq.alias("__s"))
    pairs = chars.select("pos", F.when(F.col("pos") > 0, F.substring("__s", F.col("pos"), F.lit(1))).otherwise("").alias("before"), "c")
    if pooled:
        near = pairs.filter("pos > 0").select(F.explode(F.transform(F.sequence(F.lit(-pooled), F.lit(pooled)), lambda d: d + F.col("pos"))).alias("pos"), "before", "c")
        pairs = pairs.filter("pos = 0").unionByName(near.filter((F.col("pos") > 0) & (F.col("pos") < width)))
    counts = pairs.groupBy("pos", "before", "c").agg(F.count("*").alias("n"))
    alphabet = F.count("*").over(Window.partitionBy("pos", "before"))
    logp = F.ln((F.col("n") + pseudocount) / (F.sum("n").over(Window.partitionBy("pos", "before")) + pseudocount * alphabet))
    return counts.select("pos", "before", "c", logp.alias("logp"))


def weight_array_score(df: DataFrame, ident: str, seq: Column, width: int, model: DataFrame) -> DataFrame:
    """(ident, score): the sum of a weight array's cells along each sequence; pairs without a cell add nothing."""
    chars = df.select(ident, F.posexplode(F.slice(sq.kmers(seq, 1), 1, width)).alias("pos", "c"), seq.alias("__s"))
    pairs = chars.select(ident, "pos", F.when(F.col("pos") > 0, F.substring("__s", F.col("pos"), F.lit(1))).otherwise("").alias("before"), "c")
    return pairs.join(model, ["pos", "before", "c"], "left").groupBy(ident).agg(F.coalesce(F.sum("logp"), F.lit(0.0)).alias("score"))


def periodic_chain(df: DataFrame, seq: Column, period: int = 3) -> DataFrame:
    """(phase, before, c, logp) of a first-order chain with its own parameters in each phase."""
    chars = df.select(F.posexplode(sq.kmers(seq, 2)).alias("pos", "k"))
    pairs = chars.select(((F.col("pos") + 1) % period).alias("phase"), F.substring("k", 1, 1).alias("before"), F.substring("k", 2, 1).alias("c"))
    counts = pairs.groupBy("phase", "before", "c").agg(F.count("*").alias("n"))
    return counts.withColumn("logp", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("phase", "before")))).drop("n")


#: Observations of a history from which its own distribution stands alone, and the least confidence that counts (fixed values).
ENOUGH, CONFIDENCE = 400, 0.5


def interpolated_model(df: DataFrame, seq: Column, order: int, alphabet: str, least: int = 1) -> DataFrame:
    """(history, c, logp) of an interpolated Markov model with histories of 0 to `order` characters.

    Every n-gram starts at a count of 1. A history's log probabilities mix with those of the history one shorter: its own
    count for all with ENOUGH observations, or by their share of ENOUGH times the confidence (1 - p of a chi-square fit
    of its counts to the shorter one's rounded expectations) that both differ; a confidence below CONFIDENCE is none.
    Histories of fewer than `least` observations are left out, as are those that extend them. Counting is distributed;
    the model itself has alphabet ** (order + 1) rows.
    """
    letters = F.array(*[F.lit(x) for x in alphabet])
    grid = df.sparkSession.range(1).select(F.lit("").alias("history"))
    below = None
    parts = []
    for k in range(order + 1):
        if k:
            grid = grid.select(F.explode(F.transform(letters, lambda x: F.concat(F.col("history"), x))).alias("history"))
        seen = kmer_counts(df, seq, k + 1)
        cells = grid.select("history", F.explode(letters).alias("c")).withColumn("kmer", F.concat("history", "c"))
        whole = F.sum("n").over(Window.partitionBy("history"))
        counts = cells.join(seen, "kmer", "left").select("history", "c", (F.coalesce("n", F.lit(0)) + 1).alias("n")).withColumn("all", whole)
        now = counts.filter(F.col("all") >= least).withColumn("own", F.ln(F.col("n") / F.col("all")))
        if below is None:
            below = now.select("history", "c", "n", F.col("all").alias("all"), F.col("own").alias("logp"))
        else:
            short = below.select(F.col("history").alias("shorter"), "c", F.col("n").alias("m"), F.col("all").alias("total"), F.col("logp").alias("before"))
            both = now.withColumn("shorter", F.substring("history", 2, k)).join(short, ["shorter", "c"])
            expected = F.floor(F.col("m") / F.col("total") * F.col("all") + 0.5)
            fit = F.sum((F.col("n") - expected) ** 2 / F.nullif(expected, F.lit(0))).over(Window.partitionBy("history"))
            sure = chi_square_confidence(F.coalesce(fit, F.lit(0.0)), len(alphabet) - 1)
            weight = F.when(F.col("all") >= ENOUGH, 1.0).otherwise(F.when(sure < CONFIDENCE, 0.0).otherwise(sure) * F.col("all") / ENOUGH)
            mixed = weight * F.col("own") + (1 - weight) * F.col("before")
            below = both.select("history", "c", "n", "all", mixed.alias("logp"))
        parts.append(below.select("history", "c", "logp"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def chi_square_confidence(x: Column, df: int) -> Column:
    """P(chi-square of df degrees <= x), by the finite sums for whole degrees; the normal integral is by its series."""
    half = x / 2
    if df % 2 == 0:
        terms = [F.lit(1.0)]
        for k in range(1, df // 2):
            terms.append(terms[-1] * half / k)
        return 1 - F.exp(-half) * sum(terms[1:], terms[0])
    # erf(sqrt(half)) = 2 / sqrt(pi) * exp(-half) * sqrt(half) * sum of (2 half)^k / (1 * 3 * ... (2 k + 1)); 1 from 60 on
    steps = F.sequence(F.lit(1), F.lit(300))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    series = F.aggregate(steps, zero, lambda a, k: F.struct((a["t"] * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x / (2 * k + 1)).alias("s")), lambda a: a["s"])
    scale = 2 / F.sqrt(F.pi()) * F.exp(-half) * F.sqrt(half)
    erf, tail, term = scale * series, F.lit(0.0), F.lit(1.0)
    for k in range(df // 2):
        tail = tail + term
        term = term * x / (2 * k + 3)
    return F.when(x <= 0, 0.0).when(x > 120, 1.0).otherwise(erf - scale * tail)
