"""Posteriors, prefix sums, thresholds, ranks and transitions over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scores
from .registry import query, table


@query(
    "a18_posterior_topn",
    """
WITH s AS (SELECT l_orderkey, l_linenumber, -l_extendedprice / 1e4 AS s FROM lineitem),
m AS (SELECT *, max(s) OVER (PARTITION BY l_orderkey) AS m FROM s),
p AS (SELECT l_orderkey, l_linenumber, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY l_orderkey) AS p FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(p, 9) DESC, l_linenumber) AS rank FROM p WHERE round(p, 9) >= 0.05)
SELECT l_orderkey, l_linenumber, round(round(p, 9), 6) AS posterior, rank FROM r WHERE rank <= 3
""",
)
def posterior_topn(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    p = scores.posterior(lines, ["l_orderkey"], -F.col("l_extendedprice") / 1e4)
    p = p.withColumn("posterior", F.round("posterior", 9)).filter(F.col("posterior") >= 0.05)
    best = scores.top_n(p, ["l_orderkey"], [F.desc("posterior"), F.col("l_linenumber")], 3)
    return best.select("l_orderkey", "l_linenumber", F.round("posterior", 6).alias("posterior"), F.col("rank").cast("long").alias("rank"))


@query(
    "w01_prefix_interval",
    """
SELECT user_id, event_id, row_number() OVER w - 1 AS rank, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS prefix,
       round(sum(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 4) AS interval_sum
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""",
)
def prefix_interval(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    out = scores.prefix_interval(e, ["user_id"], ["ts", "event_id"], "value", 5)
    return out.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"), F.round("prefix", 4).alias("prefix"), F.round("interval", 4).alias("interval_sum"))


@query(
    "w06_threshold_sweep",
    """
WITH d AS (SELECT CAST(floor(n_chars / 50) * 50 AS BIGINT) AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
g AS (SELECT s, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS q FROM d GROUP BY s),
c AS (SELECT s, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS np, CAST(sum(q) OVER () AS BIGINT) AS nq FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT s AS cutoff, tp, fp, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(np AS DOUBLE), 6) AS recall,
       round((tp + nq - fp) / CAST(np + nq AS DOUBLE), 6) AS accuracy FROM c
""",
)
def threshold_sweep(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    d = d.select((F.floor(F.col("n_chars") / 50) * 50).cast("long").alias("s"), F.col("quality").cast("long").alias("y"))
    out = scores.threshold_sweep(d, "s", "y")
    return out.select("cutoff", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "a19_pr_curve",
    """
WITH d AS (SELECT l_linestatus AS grp, l_quantity AS s, CAST(l_returnflag = 'R' AS BIGINT) AS y FROM lineitem),
g AS (SELECT grp, s, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS q FROM d GROUP BY ALL),
c AS (SELECT grp, s, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY grp) AS np, sum(q) OVER (PARTITION BY grp) AS nq FROM g WINDOW w AS (PARTITION BY grp ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT grp, s, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(np - tp AS DOUBLE) AS fn, CAST(nq - fp AS DOUBLE) AS tn FROM c),
x AS (SELECT grp, s, (tp + tn) / (tp + fp + fn + tn) AS acc, tp / (tp + fn) AS rec,
             coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM r)
SELECT grp, round(max(acc), 6) AS best_accuracy, round(max(mcc), 6) AS best_mcc, max(s) FILTER (WHERE rec >= 0.99) AS cutoff_99 FROM x GROUP BY grp
""",
)
def pr_curve(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("grp"), F.col("l_quantity").alias("s"), (F.col("l_returnflag") == "R").cast("long").alias("y"))
    x = scores.threshold_sweep(d, "s", "y", ["grp"])
    out = x.groupBy("grp").agg(F.max("accuracy").alias("a"), F.max("mcc").alias("m"), F.max(F.when(F.col("recall") >= 0.99, F.col("cutoff"))).alias("cutoff_99"))
    return out.select("grp", F.round("a", 6).alias("best_accuracy"), F.round("m", 6).alias("best_mcc"), "cutoff_99")


@query(
    "w11_cutoff_for_count",
    """
WITH g AS (SELECT l_returnflag, l_quantity AS s, count(*) AS c FROM lineitem GROUP BY ALL),
w AS (SELECT *, CAST(sum(c) OVER (PARTITION BY l_returnflag ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS predicted FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(predicted - 1000), predicted DESC) AS k FROM w)
SELECT l_returnflag, s AS cutoff, predicted FROM r WHERE k = 1
""",
)
def cutoff_for_count(spark, sf):
    return scores.cutoff_for_count(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", 1000)


@query(
    "w10_rank_paths",
    """
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5
""",
)
def rank_paths(spark, sf):
    best = scores.top_n(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return best.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(
    "o05_top_termini",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
)
def top_termini(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query(
    "j13_until_flag",
    """
SELECT user_id, event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS until_id FROM events
""",
)
def until_flag(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    out = scores.until_flag(e, ["user_id"], ["event_id"], F.col("event_type") == "purchase")
    return out.select("user_id", "event_id", F.col("until.event_id").alias("until_id"))


@query(
    "j14_asof",
    """
SELECT e.event_id, e.user_id, s.event_id AS signup_id
FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts
""",
)
def asof(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    found = scores.last_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"))
    return e.withColumn("signup_id", found).select("event_id", "user_id", "signup_id")


@query(
    "a16_transitions",
    """
WITH n AS (SELECT event_type AS from_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_state FROM events),
c AS (SELECT from_state, to_state, count(*) AS n FROM n WHERE to_state IS NOT NULL GROUP BY ALL)
SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS p, round(ln(n / sum(n) OVER (PARTITION BY from_state)), 6) AS log_p FROM c
""",
)
def transitions(spark, sf):
    out = scores.transitions(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.select("from_state", "to_state", "n", F.round("p", 6).alias("p"), F.round("log_p", 6).alias("log_p"))


@query(
    "x13_geometric",
    "SELECT p_partkey, round(ln(0.2) + (p_size - 1) * ln(0.8), 6) AS log_p FROM part",
)
def geometric(spark, sf):
    p = 0.2
    return table(spark, sf, "part").select("p_partkey", F.round(F.ln(F.lit(p)) + (F.col("p_size") - 1) * F.ln(F.lit(1 - p)), 6).alias("log_p"))


@query(
    "w03_phase",
    """
SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) % 3 AS phase FROM
(SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)
""",
)
def phase(spark, sf):
    exons = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("n"))
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    return exons.select("l_orderkey", "l_linenumber", F.pmod(F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(3)).cast("long").alias("phase"))
