"""Models trained and sites searched in sequences that digests of part keys spell, and pieces cut around masked intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, models, signals, training
from .registry import query, table
from .sequence_queries import _DNA, _dna

#: 320 bases of each part.
_SEQ = "d AS (SELECT p_partkey AS id, translate(array_to_string(list_transform(range(0, 10), lambda j: md5(concat(p_partkey, ':', j))), ''), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part)"


def _seq(spark, sf):
    text = F.expr("translate(array_join(transform(sequence(0, 9), j -> md5(concat(p_partkey, ':', j))), ''), '0123456789abcdef', 'ACGTACGTACGTACGT')")
    # keys are dealt out before they unfold: their file is small enough for one task, their sequences aren't
    parts = table(spark, sf, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(F.col("p_partkey").alias("id"), text.alias("s"))


def _rule(a: int, b: int):
    """A weight by position and base (A 0, C 1, G 2, T 3), as Python and as SQL over a window."""
    from math import log

    def sql(window: str, width: int) -> str:
        return f"list_sum(list_transform(range({width}), lambda zz: ln((1 + (zz * {a} + (instr('ACGT', substr({window}, CAST(zz + 1 AS INT), 1)) - 1) * {b}) % 4) / 10.0)))"

    return (lambda pos, base: log((1 + (pos * a + base * b) % 4) / 10.0)), sql


def _model(spark, rule, width: int):
    cells = [(p, c, rule(p, k)) for p in range(width) for k, c in enumerate("ACGT")]
    return models.matrix_map(spark.createDataFrame(cells, "pos int, symbol string, log_p double"))


_TATA, _TATA_SQL = _rule(3, 1)
_CAP, _CAP_SQL = _rule(1, 3)
_RATIO, _RATIO_SQL = _rule(2, 1)
_PLAIN = "list_sum(list_transform(string_split(concat(substr(w, 9, CAST(d AS INT)), substr(w, CAST(15 + d AS INT))), ''), lambda c: ln((1 + instr('ACGT', c)) / 14.0)))"


@query(
    "m08_paired_sites",
    f"""WITH {_SEQ}, k AS (SELECT id, CAST(i AS INT) AS pos, substr(s, CAST(i + 1 AS INT), 32) AS f FROM d, unnest(generate_series(0, length(s) - 32)) u(i)),
w AS (SELECT id, pos, '+' AS strand, f AS w FROM k UNION ALL SELECT id, pos, '-', reverse(translate(f, 'ACGT', 'TGCA')) FROM k),
t AS (SELECT * FROM w WHERE substr(w, 3, 4) = 'TATA'), c AS (SELECT t.*, d, substr(w, CAST(9 + d AS INT), 6) AS p FROM t, unnest(generate_series(8, 18)) u(d)),
o AS (SELECT *, round({_RATIO_SQL("p", 6)}, 9) AS r FROM c WHERE substr(p, 2, 1) = 'C' AND substr(p, 3, 1) IN ('A', 'T') AND substr(p, 4, 1) <> 'G'),
b AS (SELECT *, row_number() OVER (PARTITION BY id, pos, strand ORDER BY r DESC, CASE strand WHEN '+' THEN d ELSE -d END) AS n FROM o)
SELECT id, pos, strand, CAST(d AS INT) AS spacing, round({_TATA_SQL("w", 8)} + {_CAP_SQL("p", 6)} + {_PLAIN}, 6) AS score FROM b WHERE n = 1""",
)
def paired_sites(spark, sf):
    from math import log

    background = spark.createDataFrame([(c, log((2 + k) / 14.0)) for k, c in enumerate("ACGT")], "symbol string, log_p double")
    found = signals.paired_sites(_seq(spark, sf), "id", "s", _model(spark, _TATA, 8), 8, 2, "TATA", _model(spark, _CAP, 6), _model(spark, _RATIO, 6), 6, background, 8, 18)
    return found.withColumn("score", F.round("score", 6))


_LONG, _LONG_SQL = _rule(1, 1)
_SHORT, _SHORT_SQL = _rule(2, 3)


def _start_sql(rna: str, at: str) -> str:
    far, near = _LONG_SQL(f"substr({rna}, CAST({at} - 3 AS INT), 12)", 12), _SHORT_SQL(f"substr({rna}, CAST({at} + 1 AS INT), 5)", 5)
    return f"CASE WHEN {at} >= 0 AND substr({rna}, CAST({at} + 1 AS INT), 3) = 'ATG' THEN CASE WHEN {at} >= 4 AND {at} + 8 <= length({rna}) THEN {far} WHEN {at} + 5 <= length({rna}) THEN {near} END END"


@query(
    "p07_lost_upstream_orfs",
    f"""WITH {_SEQ}, a AS (SELECT id, s, concat(substr(replace(s, 'ATGC', 'ATCC'), 1, 60), 'GAT', substr(replace(s, 'ATGC', 'ATCC'), 61, 60), substr(replace(s, 'ATGC', 'ATCC'), 131)) AS v FROM d),
r AS (SELECT id, concat(substr(s, 11, 80), substr(s, 116, 65), substr(s, 231, 80)) AS rr, concat(substr(v, 11, 83), substr(v, 119, 58), substr(v, 224, 80)) AS ar FROM a),
t AS (SELECT id, rr, ar, CAST(i AS INT) AS st, {_start_sql("rr", "i")} AS ref_score FROM r, unnest(generate_series(0, 99)) u(i) WHERE substr(rr, CAST(i + 1 AS INT), 3) = 'ATG'),
g AS (SELECT *, CAST(CASE WHEN st < 80 THEN 10 + st ELSE 115 + st - 80 END AS INT) AS ref_pos FROM t WHERE ref_score >= -12.3456),
m AS (SELECT *, CAST(CASE WHEN ref_pos < 60 THEN ref_pos WHEN ref_pos < 120 THEN ref_pos + 3 WHEN ref_pos < 130 THEN 122 ELSE ref_pos - 7 END AS INT) AS alt_pos FROM g),
z AS (SELECT *, CASE WHEN alt_pos >= 10 AND alt_pos < 93 THEN alt_pos - 10 WHEN alt_pos >= 118 AND alt_pos < 176 THEN alt_pos - 118 + 83 WHEN alt_pos >= 223 AND alt_pos < 303 THEN alt_pos - 223 + 141 ELSE -1 END AS "to" FROM m),
n AS (SELECT *, {_start_sql("ar", '"to"')} AS alt_score FROM z),
e AS (SELECT n.*, (SELECT min(j) FROM unnest(generate_series(st + 3, length(rr) - 3, 3)) q(j) WHERE substr(rr, CAST(j + 1 AS INT), 3) IN ('TAA', 'TAG', 'TGA')) AS stop FROM n)
SELECT id, ref_pos, alt_pos, round(ref_score, 6) AS ref_score, round(alt_score, 6) AS alt_score, CAST(coalesce(stop + 3 - st, (length(rr) - st) // 3 * 3) AS INT) AS length FROM e WHERE coalesce(alt_score < -12.3456, true)""",
)
def lost_upstream_orfs(spark, sf):
    """Upstream start codons that a substitution, an insertion of three and a deletion of ten bases undo."""
    v = F.replace(F.col("s"), F.lit("ATGC"), F.lit("ATCC"))
    exons = lambda *x: F.array(*[F.struct(F.lit(b).alias("begin"), F.lit(e).alias("end")) for b, e in x])
    rows = _seq(spark, sf).select("id", "s", F.concat(F.substring(v, 1, 60), F.lit("GAT"), F.substring(v, 61, 60), F.substring(v, 131, 320)).alias("v"), exons((10, 90), (115, 180), (230, 310)).alias("rx"), exons((10, 93), (118, 176), (223, 303)).alias("ax"), F.lit("60M3I60M10D190M").alias("cigar"), F.lit(135).alias("cds"))
    sensor = signals.Sensor(width=12, offset=4, consensus=("ATG",), cutoff=-12.3456)
    found = signals.lost_upstream_orfs(rows, "id", "s", "v", "rx", "ax", "cigar", "cds", _model(spark, _LONG, 12), sensor, _model(spark, _SHORT, 5), 5)
    return found.withColumns({"ref_score": F.round("ref_score", 6), "alt_score": F.round("alt_score", 6)})


_SIDES = ", ".join(f"({k}, '{s}')" for k, s in enumerate(training.SIDES))


def _split_sql(k: int) -> str:
    """CTEs b{k} and w{k + 1}: the splits of the nodes in w{k}, and the windows in their children."""
    return f"""c{k} AS (SELECT node, u.p, v.q, o, contains(bases, substr(s, CAST(u.p + 1 AS INT), 1)) AS l, substr(s, CAST(v.q + 1 AS INT), 1) AS b, CAST(count(*) AS DOUBLE) AS n FROM w{k}, unnest(range(6)) u(p), unnest(range(6)) v(q), (VALUES {_SIDES}) z(o, bases) WHERE u.p <> v.q AND node IN (SELECT node FROM w{k} GROUP BY 1 HAVING count(*) >= 40) GROUP BY ALL),
x{k} AS (SELECT *, sum(n) OVER (PARTITION BY node, p, q, o) AS t, n * n / (sum(n) OVER (PARTITION BY node, p, q, o, b) * sum(n) OVER (PARTITION BY node, p, q, o, l)) AS f FROM c{k}),
h{k} AS (SELECT node, p, o, sum(chi) AS score FROM (SELECT node, p, q, o, max(t) * (sum(f) - 1) AS chi FROM x{k} GROUP BY ALL) GROUP BY ALL HAVING max(chi) >= 7.815),
r{k} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(score, 6) DESC, p, o) AS n FROM h{k}),
y{k} AS (SELECT w.id, s, w.node, p, bases, score, contains(bases, substr(s, CAST(p + 1 AS INT), 1)) AS l FROM w{k} w JOIN r{k} r ON r.node = w.node AND r.n = 1 JOIN (VALUES {_SIDES}) z(o, bases) USING (o)),
b{k} AS (SELECT node, p AS pos, bases AS "left", round(any_value(score), 2) AS score, count(*) AS n, count(*) FILTER (l) AS n_left FROM y{k} GROUP BY ALL HAVING count(*) FILTER (l) >= 40 AND count(*) FILTER (NOT l) >= 40),
w{k + 1} AS (SELECT id, s, CASE WHEN l THEN 2 * node ELSE 2 * node + 1 END AS node FROM y{k} SEMI JOIN b{k} USING (node))"""


@query("m05_mdd_tree", f"""WITH w0 AS (SELECT p_partkey AS id, substr({_DNA}, 1, 6) AS s, 1 AS node FROM part), {_split_sql(0)}, {_split_sql(1)}, {_split_sql(2)}
SELECT CAST(node AS INT) AS node, CAST(pos AS INT) AS pos, "left", score, n, n_left FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2)""")
def mdd_tree(spark, sf):
    """Three levels of a decision tree over the first six bases of part names."""
    windows = _dna(spark, sf).select(F.substring("dna", 1, 6).alias("s"))
    splits = training.train_tree(windows, "s", 6, 40, 3)
    rows = [(s.node, s.pos, s.left, round(s.score, 2), s.n, s.n_left) for s in splits]
    return spark.createDataFrame(rows, "node int, pos int, left string, score double, n long, n_left long")


_SEED, _SEED_SQL = _rule(1, 2)
_ALLOWED = "('AATAAA', 'ATTAAA')"


def _round_sql(k: int) -> str:
    return f"""e{k} AS (SELECT id, pos, w, round(sum(lp), 9) AS sc FROM h, unnest(range(10)) u(p) JOIN m{k} ON m{k}.pos_ = u.p AND m{k}.c = substr(h.w, CAST(u.p + 1 AS INT), 1) GROUP BY ALL),
q{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, pos DESC) AS n FROM e{k}) WHERE n = 1),
t{k} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sc DESC, id) AS k, count(*) OVER () AS total FROM q{k}) WHERE k <= floor(0.6 * total)),
m{k + 1} AS (SELECT g.pos_, g.c, ln((coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY g.pos_)) AS lp FROM grid g LEFT JOIN (SELECT u.p AS pos_, substr(w, CAST(u.p + 1 AS INT), 1) AS c, count(*) AS n FROM t{k}, unnest(range(10)) u(p) GROUP BY ALL) z ON z.pos_ = g.pos_ AND z.c = g.c)"""


@query(
    "m18_refined_matrix",
    f"""WITH {_SEQ}, grid AS (SELECT CAST(p AS INT) AS pos_, c, k FROM unnest(range(10)) u(p), (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3)) v(c, k)), m0 AS (SELECT pos_, c, ln((1 + (pos_ + k * 2) % 4) / 10.0) AS lp FROM grid),
h AS (SELECT id, CAST(i AS INT) AS pos, substr(s, CAST(i + 1 AS INT), 10) AS w FROM d, unnest(range(0, length(s) - 10)) u(i) WHERE substr(s, CAST(i + 3 AS INT), 6) IN {_ALLOWED}),
{_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)} SELECT pos_ AS pos, c AS symbol, round(lp, 6) AS log_p FROM m3""",
)
def refined_matrix(spark, sf):
    """Three rounds from a seed matrix: the best window of each sequence, the top 60 %, a new matrix."""
    cells = [(p, c, _SEED(p, k)) for p in range(10) for k, c in enumerate("ACGT")]
    seed = spark.createDataFrame(cells, "pos int, symbol string, log_p double")
    out = training.refine(_seq(spark, sf), "id", "s", seed, 10, 2, ["AATAAA", "ATTAAA"], 0.6, 3)
    return out.withColumn("log_p", F.round("log_p", 6))


@query("m10_sensitivity_cutoff", "WITH s AS (SELECT l_extendedprice / l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM s) SELECT round(max(v), 3) AS cutoff FROM r WHERE k <= CAST(floor(n * (1.0::DOUBLE - 0.99::DOUBLE)) AS INT)")
def sensitivity_cutoff(spark, sf):
    scored = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    return training.cutoff_for_sensitivity(scored, "v", 0.99)


@query("m10_logistic_training")
def logistic_training(spark, sf):
    """Weights of a logistic model that tells part names whose first base is followed by its like; held against a fixture in the tests."""
    rows = _dna(spark, sf).select(F.substring("dna", 1, 6).alias("s"), (F.substring("dna", 7, 1) == F.substring("dna", 1, 1)).cast("int").alias("y"))
    return training.train_logistic(rows, "y", "s", 6, 0.5, [0.01, 0.1], 3)[1]


_MASK = "m AS (SELECT l_returnflag AS chr, l_orderkey * 100 + l_linenumber AS b, CAST(l_orderkey * 100 + l_linenumber + l_quantity AS BIGINT) AS e FROM lineitem)"


@query(
    "w07_segments",
    f"""WITH RECURSIVE {_MASK}, len AS (SELECT chr, max(e) + 7 AS n FROM m GROUP BY 1 UNION ALL SELECT 'none', 1234),
i AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY chr ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= b THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM i), isl AS (SELECT chr, min(b) AS ib, max(e) AS ie FROM g GROUP BY chr, k),
seg(chr, b, e, n) AS (SELECT chr, CAST(0 AS BIGINT), CAST(0 AS BIGINT), n FROM len UNION ALL
SELECT s.chr, s.e, CAST(least(coalesce(ie, s.e + 20000), n) AS BIGINT), n FROM (SELECT chr, e, n, least(e + 20000, n) AS ahead FROM seg WHERE e < n) s LEFT JOIN isl ON isl.chr = s.chr AND ib <= ahead AND ahead < ie AND ahead < n)
SELECT chr, b AS "begin", e AS "end" FROM seg WHERE e > 0""",
)
def segments(spark, sf):
    """Pieces of 20,000 positions whose cuts avoid every line's interval."""
    c = F.col
    m = table(spark, sf, "lineitem").select(c("l_returnflag").alias("chr"), (c("l_orderkey") * 100 + c("l_linenumber")).alias("b"), (c("l_orderkey") * 100 + c("l_linenumber") + c("l_quantity")).cast("long").alias("e"))
    lengths = m.groupBy("chr").agg((F.max("e") + 7).alias("n")).unionByName(spark.createDataFrame([("none", 1234)], "chr string, n long"))
    return intervals.segments(m, lengths, "chr", "b", "e", "n", 20000)
