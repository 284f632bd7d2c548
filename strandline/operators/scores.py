"""Score operators: prefix sums, posteriors, thresholds, running statistics, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_interval(df: DataFrame, by: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """For each row the sum over its next `width` rows, as a difference of prefix sums; short tails sum what is there."""
    w = Window.partitionBy(*by).orderBy(*order)
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__rank", F.row_number().over(w) - 1).withColumn("prefix", total)
    before = F.coalesce(F.lag("prefix").over(w), F.lit(0.0))
    last = F.last("prefix").over(w.rowsBetween(0, width - 1))
    return df.withColumn("rank", F.col("__rank")).withColumn("interval", last - before).drop("__rank")


def posterior(df: DataFrame, by: list[str], score: Column) -> DataFrame:
    """Softmax of the scores within a group, shifted by the largest; -infinity means impossible and gets 0."""
    w = Window.partitionBy(*by)
    df = df.withColumn("__s", score)
    df = df.withColumn("__e", F.when(F.col("__s") == float("-inf"), 0.0).otherwise(F.exp(F.col("__s") - F.max("__s").over(w))))
    total = F.sum("__e").over(w)
    return df.withColumn("posterior", F.when(total > 0, F.col("__e") / total).otherwise(0.0)).drop("__s", "__e")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def threshold_sweep(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct score, taken as the least score called positive: counts and the usual rates.

    Counts are combined per score before anything is ordered, so one window sees as many rows as there are scores.
    """
    by = by or []
    per = df.groupBy(*by, score).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    whole, down = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    c = per.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("q").over(down), "pos": F.sum("p").over(whole), "neg": F.sum("q").over(whole)})
    c = c.withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")})
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        *by, F.col(score).alias("cutoff"), "tp", "fp", "fn", "tn",
        (tp / (tp + fp)).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0.0))).alias("recall"),
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), F.coalesce((tp * tn - fp * fn) / F.nullif(root, F.lit(0.0)), F.lit(0.0)).alias("mcc"),
    )


def cutoff_for_count(df: DataFrame, by: list[str], score: str, n: int) -> DataFrame:
    """The cutoff whose number of predictions is nearest n; scores that tie go in or out together, ties of distance in."""
    per = df.groupBy(*by, score).agg(F.count("*").alias("c"))
    down = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    swept = per.withColumn("predicted", F.sum("c").over(down)).withColumn("off", F.abs(F.col("predicted") - n))
    best = F.min(F.struct("off", (-F.col("predicted")).alias("p"), F.col(score).alias("s")))
    return swept.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.s").alias("cutoff"), (-F.col("b.p")).alias("predicted"))


def until_flag(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """For each row the position of the next flagged row at or after it (null: none)."""
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("__f", flag).withColumn("until", F.first(F.when(F.col("__f"), F.struct(*order)), ignorenulls=True).over(ahead)).drop("__f")


def last_before(df: DataFrame, by: list[str], order: list[str], flag: Column, value: Column) -> Column:
    """value of the last flagged row at or before each row."""
    back = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(flag, value), ignorenulls=True).over(back)


def transitions(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """How often each state follows another, the share among what follows it, and its natural logarithm."""
    nxt = F.lead(state).over(Window.partitionBy(*by).orderBy(*order))
    counts = df.select(F.col(state).alias("from_state"), nxt.alias("to_state")).filter(F.col("to_state").isNotNull()).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("from_state"))
    return counts.withColumn("p", p).withColumn("log_p", F.ln(p))


def longest_per_group(df: DataFrame, by: list[str], length: Column, tie: str) -> DataFrame:
    """The longest row of each group, the first on ties; a struct minimum, so groups never gather in a window."""
    best = F.min(F.struct((-length).alias("l"), F.col(tie).alias("t")))
    return df.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.t").alias(tie), (-F.col("b.l")).alias("length"))
