"""Training of sequence models: decision trees of weight matrices, refinement to a fixed point, logistic regression.

Every pass over the sequences is an aggregation; what the driver loops over is a model, never a sequence.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..sources.tables import scratch
from . import models

#: Chi-square of three degrees of freedom beyond which two positions depend on each other, at 0.05 (fixed value).
DEPENDS = 7.815
#: The ways to split four bases in two, by the side that A, C and G make up, in the order they are tried (fixed values).
SIDES = ["A", "C", "AC", "G", "AG", "CG", "ACG"]


@dataclass(frozen=True)
class Split:
    """A node (its children are 2 node and 2 node + 1): windows whose base at pos is among left go left."""

    node: int
    pos: int
    left: str
    score: float
    n: int
    n_left: int


def _pairs(windows: DataFrame, seq: str, width: int) -> DataFrame:
    """(node, p, a, q, b, n): how often base a at p comes with base b at another position q."""
    cells = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.struct((i - 1).alias("p"), F.substring(F.col(seq), i, F.lit(1)).alias("a")))
    one = windows.select("node", cells.alias("cells")).select("node", "cells", F.inline("cells").alias("p", "a"))
    two = one.select("node", "p", "a", F.inline("cells").alias("q", "b")).filter("p <> q and a in ('A', 'C', 'G', 'T') and b in ('A', 'C', 'G', 'T')")
    return two.groupBy("node", "p", "a", "q", "b").agg(F.count("*").alias("n"))


def best_splits(windows: DataFrame, seq: str, width: int) -> DataFrame:
    """(node, pos, left, score, n_left, n): of each node the split with the largest sum of chi-squares against all other positions.

    A split counts only if at least one position depends on it; ties go to the smaller position, then to the earlier side.
    Scores are compared at six decimals. Bases other than A, C, G and T are left out of the counts.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.lit(s).alias("bases")) for k, s in enumerate(SIDES)]))
    cells = _pairs(windows, seq, width).select("*", sides.alias("s")).select("node", "p", F.col("s.side").alias("side"), "q", "b", F.col("s.bases").contains(F.col("a")).alias("is_left"), "n")
    table = cells.groupBy("node", "p", "side", "q", "b", "is_left").agg(F.sum("n").cast("double").alias("n"))
    on = Window.partitionBy("node", "p", "side", "q")  # at most eight cells
    row, col = Window.partitionBy("node", "p", "side", "q", "b"), Window.partitionBy("node", "p", "side", "q", "is_left")
    share = table.select("*", F.sum("n").over(on).alias("t"), (F.col("n") * F.col("n") / (F.sum("n").over(row) * F.sum("n").over(col))).alias("part"), F.col("is_left").cast("int").alias("l"))
    chi = share.groupBy("node", "p", "side", "q").agg((F.first("t") * (F.sum("part") - 1)).alias("chi"), F.sum(F.col("n") * F.col("l")).alias("n_left"), F.first("t").alias("n"))
    scored = chi.groupBy("node", "p", "side").agg(F.sum("chi").alias("score"), F.max("chi").alias("most")).filter(F.col("most") >= DEPENDS)
    best = scored.groupBy("node").agg(F.min(F.struct((-F.round("score", 6)).alias("s"), "p", "side")).alias("b"))
    name = reduce(lambda acc, kv: acc.when(F.col("b.side") == kv[0], kv[1]), enumerate(SIDES), F.when(F.lit(False), ""))
    return best.select("node", F.col("b.p").alias("pos"), name.alias("left"), (-F.col("b.s")).alias("score"))


def _children(seq: str, splits: list[Split]) -> Column:
    """The node a window goes to, from the node it is in; null where that node isn't split."""
    out = F.lit(None).cast("int")
    for s in splits:
        base = F.substring(F.col(seq), s.pos + 1, 1)
        out = F.when(F.col("node") == s.node, F.when(F.lit(s.left).contains(base) & (base != ""), 2 * s.node).otherwise(2 * s.node + 1)).otherwise(out)
    return out


def leaf_of(seq: str, splits: list[Split]) -> Column:
    """The leaf of a window: the splits of the tree, root first, as nested conditions."""
    by_node = {s.node: s for s in splits}

    def below(node: int) -> Column:
        if node not in by_node:
            return F.lit(node)
        base = F.substring(F.col(seq), by_node[node].pos + 1, 1)
        return F.when(F.lit(by_node[node].left).contains(base) & (base != ""), below(2 * node)).otherwise(below(2 * node + 1))

    return below(1)


def train_tree(windows: DataFrame, seq: str, width: int, least: int, depth: int) -> list[Split]:
    """Splits of a decision tree over windows of one width, level by level, one aggregation for all open nodes of a level.

    A node is split while it holds `least` windows, as do both of its children, and lies above `depth`. The driver keeps the
    splits, fewer than 2 ** depth.
    """
    splits: list[Split] = []
    at, open_ = windows.withColumn("node", F.lit(1)), {1}
    for _ in range(depth):
        sizes = {r["node"]: r["n"] for r in at.groupBy("node").agg(F.count("*").alias("n")).collect()}
        tried = at.filter(F.col("node").isin([v for v in open_ if sizes.get(v, 0) >= least]))
        found = [Split(r["node"], r["pos"], r["left"], r["score"], sizes[r["node"]], 0) for r in best_splits(tried, seq, width).collect()]
        if not found:
            break
        moved = at.withColumn("__to", _children(seq, found)).filter("__to is not null")
        counts = {r["__to"]: r["n"] for r in moved.groupBy("__to").agg(F.count("*").alias("n")).collect()}
        kept = [Split(s.node, s.pos, s.left, s.score, s.n, counts.get(2 * s.node, 0)) for s in found if min(counts.get(2 * s.node, 0), counts.get(2 * s.node + 1, 0)) >= least]
        if not kept:
            break
        splits += kept
        open_ = {v for s in kept for v in (2 * s.node, 2 * s.node + 1)}
        at = windows.withColumn("node", leaf_of(seq, splits))
    return sorted(splits, key=lambda s: s.node)


def train_leaves(windows: DataFrame, seq: str, width: int, splits: list[Split], pseudocount: float = 1.0) -> DataFrame:
    """(leaf, branch_log_p, matrix): of each leaf the log share of windows on every branch down to it, and its weight matrix."""
    rows = windows.select(F.col(seq).alias("w")).withColumn("leaf", leaf_of("w", splits))
    cells = rows.select("leaf", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.substring(F.col("w"), i, F.lit(1)))).alias("pos", "symbol"))
    counts = cells.groupBy("leaf", "pos", "symbol").agg(F.count("*").alias("n"))
    grid = cells.select("leaf").distinct().select("leaf", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("pos")).select("leaf", "pos", F.explode(F.array(*[F.lit(c) for c in "ACGT"])).alias("symbol"))
    full = grid.join(counts, ["leaf", "pos", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + pseudocount)
    full = full.withColumn("log_p", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("leaf", "pos"))))
    matrices = full.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("symbol")), "log_p"))).alias("matrix"))
    by_node = {s.node: s for s in splits}

    def branch(leaf: int) -> float:
        total = 0.0
        while leaf > 1:
            s = by_node[leaf // 2]
            total += math.log((s.n_left if leaf % 2 == 0 else s.n - s.n_left) / s.n)
            leaf //= 2
        return total

    leaves = [1] if not splits else [v for s in splits for v in (2 * s.node, 2 * s.node + 1) if v not in by_node]
    shares = reduce(lambda acc, v: acc.when(F.col("leaf") == v, branch(v)), leaves, F.when(F.lit(False), 0.0))
    return matrices.select("leaf", shares.alias("branch_log_p"), "matrix")


def tree_score(df: DataFrame, seq: str, width: int, splits: list[Split], leaves: DataFrame) -> DataFrame:
    """df with leaf and log_p of each window: its branches and its leaf's matrix. leaves has a row for each leaf of the tree."""
    placed = df.withColumn("leaf", leaf_of(seq, splits)).join(F.broadcast(leaves), "leaf")  # fewer than 2 ** depth rows
    return placed.withColumn("log_p", F.col("branch_log_p") + sq.weight_matrix_score(F.col(seq), F.col("matrix"), width)).drop("branch_log_p", "matrix")


def allowed_windows(margins: DataFrame, ident: str, seq: str, width: int, offset: int, consensus: list[str]) -> DataFrame:
    """(ident, pos, window) of the windows with an allowed consensus. As the model was defined, a margin's very last window is
    never tried."""
    found = sq.windows_at(F.upper(seq), "|".join(re.escape(c) for c in consensus), [offset], width)
    # outer, since Spark would else work out every array twice, once to see whether it is empty
    return margins.select(ident, F.length(seq).alias("__n"), F.inline_outer(found)).filter(F.col("pos") < F.col("__n") - width).drop("__n")


def _best(allowed: DataFrame, ident: str, matrix: dict[str, float], width: int) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in matrix.items() for x in kv])
    scored = allowed.withColumn("score", F.round(sq.weight_matrix_score(F.col("window"), table, width), 9)).filter("score is not null")
    return scored.groupBy(ident).agg(F.max(F.struct("score", "pos", "window")).alias("b")).select(ident, "b.pos", "b.window", "b.score")


def best_windows(margins: DataFrame, ident: str, seq: str, matrix: dict[str, float], width: int, offset: int, consensus: list[str]) -> DataFrame:
    """(ident, pos, window, score): the best window of each margin among those with an allowed consensus; ties go to the last."""
    return _best(allowed_windows(margins, ident, seq, width, offset, consensus), ident, matrix, width)


def refine(margins: DataFrame, ident: str, seq: str, matrix: DataFrame, width: int, offset: int, consensus: list[str], fraction: float, rounds: int) -> DataFrame:
    """The matrix (pos, symbol, log_p) after rounds of: the best window of each margin, the top fraction of those by score
    (rounded down, ties to the smaller ident), a matrix trained on them. Stops early once a round changes nothing.

    Margins are searched once; the windows found, few of all, are written to the shared folder for the rounds."""
    spark = margins.sparkSession
    own = {f"{r['pos']}:{r['symbol']}": r["log_p"] for r in matrix.collect()}  # width x alphabet cells
    path = f"{scratch(spark)}/windows-{uuid.uuid4().hex}"
    allowed_windows(margins, ident, seq, width, offset, consensus).write.parquet(path)
    allowed = spark.read.parquet(path)
    for _ in range(rounds):
        best = _best(allowed, ident, own, width)
        keep = int(fraction * best.count())
        top = best.orderBy(F.desc("score"), ident).limit(keep)
        new = {f"{r['pos']}:{r['symbol']}": r["log_p"] for r in models.train_weight_matrix(top, F.col("window"), width, "ACGT").collect()}
        if new == own:
            break
        own = new
    return spark.createDataFrame([(int(k.split(":")[0]), k.split(":")[1], v) for k, v in own.items()], "pos int, symbol string, log_p double")


def one_hot(seq: Column, width: int, alphabet: str = "ACGT") -> Column:
    """array<double> of width x alphabet indicators."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.transform(F.array(*[F.lit(c) for c in alphabet]), lambda c: (F.substring(seq, i, F.lit(1)) == c).cast("double"))))


def train_logistic(df: DataFrame, label: str, seq: str, width: int, mixing: float, penalties: list[float], folds: int, seed: int = 1):
    """A logistic model of one-hot windows: elastic net with the penalty that cross-validation finds best; (model, weights).

    weights: (pos, symbol, beta) and one row with null pos, the intercept. The folds are dealt by a hash of seed and window, so
    they don't depend on partitioning, and equal windows are in one fold.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(seq)), F.lit(folds)).cast("int")
    rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(one_hot(F.upper(seq), width)).alias("features"), fold.alias("fold"))
    learner = LogisticRegression(elasticNetParam=mixing, maxIter=50, standardization=False)
    grid = ParamGridBuilder().addGrid(learner.regParam, penalties).build()
    search = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol="fold", seed=seed, parallelism=2)
    model = search.fit(rows).bestModel
    cells = [(k // 4, "ACGT"[k % 4], float(b)) for k, b in enumerate(model.coefficients)]
    return model, df.sparkSession.createDataFrame([*cells, (None, None, float(model.intercept))], "pos int, symbol string, beta double")


def cutoff_for_sensitivity(scored: DataFrame, score: str, sensitivity: float, digits: int = 3) -> DataFrame:
    """One row, cutoff: the score at index int(n (1 - sensitivity)) in ascending order, rounded. No scores give no row."""
    n = scored.agg(F.count(score)).first()[0]
    low = scored.filter(F.col(score).isNotNull()).orderBy(score).limit(int(n * (1.0 - sensitivity)) + 1)
    return low.agg(F.round(F.max(score), digits).alias("cutoff")).filter("cutoff is not null")
