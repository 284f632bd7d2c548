"""Sequence functions and models over the text columns of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import models
from .registry import query, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ "

#: DNA made of names: characters map to bases by code (fixed rule of the queries below).
_DNA = "translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'ACGTACGTACGTACGTACGTACGTACA')"


def _dna(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_DNA).alias("dna"))


@query("x02_revcomp", f"SELECT p_partkey, reverse(translate({_DNA}, 'ACGTacgt', 'TGCAtgca')) AS rc FROM part")
def revcomp(spark, sf):
    return _dna(spark, sf).select("p_partkey", sq.reverse_complement(F.col("dna")).alias("rc"))


_CODONS_SQL = ", ".join(f"('{c}', '{a}')" for c, a in sq.CODONS.items())


@query(
    "x03_codons",
    f"""
WITH d AS (SELECT p_partkey, {_DNA} AS dna FROM part), c AS (SELECT * FROM (VALUES {_CODONS_SQL}) v(codon, aa)),
k AS (SELECT p_partkey, i, substr(dna, CAST(i * 3 + 1 AS INT), 3) AS codon FROM d, unnest(generate_series(0, CAST(floor(length(dna) / 3) AS INT) - 1)) u(i))
SELECT p_partkey, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS protein FROM k LEFT JOIN c USING (codon) GROUP BY 1
""",
)
def codons(spark, sf):
    return _dna(spark, sf).select("p_partkey", sq.translate_codons(F.col("dna")).alias("protein"))


@query("x08_stop_position", f"WITH d AS (SELECT p_partkey, {_DNA} AS dna FROM part) SELECT p_partkey, instr(dna, 'TAA') - 1 AS first_taa, starts_with(dna, 'ATG') AS has_start FROM d")
def stop_position(spark, sf):
    return _dna(spark, sf).select("p_partkey", (F.instr("dna", "TAA") - 1).cast("long").alias("first_taa"), F.col("dna").startswith("ATG").alias("has_start"))


@query("x15_round", "SELECT l_orderkey, l_linenumber, floor(10000 * l_discount / 0.3 + 5.0 / 9.0) / 100 AS percent FROM lineitem")
def rounding(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sq.percent(F.col("l_discount") / 0.3).alias("percent"))


@query("x01_masked_window", f"WITH d AS (SELECT p_partkey, {_DNA} AS s FROM part) SELECT p_partkey, concat(lower(substr(s, 1, 4)), '_', upper(substr(s, 5, 2)), '_', lower(substr(s, 7, 4))) AS win FROM d")
def masked_window(spark, sf):
    return _dna(spark, sf).select("p_partkey", sq.masked_window(F.col("dna"), F.lit(4), 4, 2).alias("win"))


@query(
    "a05_base_fraction",
    "SELECT doc_id, round(length(regexp_replace(text, '[^GCgc]', '', 'g')) / CAST(nullif(length(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 0) AS DOUBLE), 6) AS gc FROM documents",
)
def base_fraction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(sq.base_fraction(F.col("text"), "GCgc", "ACGTacgt"), 6).alias("gc"))


@query("a08_kmers", "WITH k AS (SELECT substr(p_name, CAST(i AS INT), 3) AS kmer FROM part, unnest(generate_series(1, length(p_name) - 2)) u(i)) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def kmers(spark, sf):
    return models.kmer_counts(table(spark, sf, "part").select("p_name"), F.col("p_name"), 3)


@query(
    "a09_mean_kmer_weight",
    """
WITH k AS (SELECT p_partkey, substr(p_name, CAST(i AS INT), 3) AS kmer FROM part, unnest(generate_series(1, length(p_name) - 3)) u(i)),
w AS (SELECT kmer, ln(count(*)) AS weight FROM (SELECT substr(p_name, CAST(i AS INT), 3) AS kmer FROM part, unnest(generate_series(1, length(p_name) - 2)) u(i)) GROUP BY 1)
SELECT p_partkey, round(avg(weight), 6) AS mean_weight FROM k JOIN w USING (kmer) GROUP BY 1
""",
)
def mean_kmer_weight(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    weights = models.kmer_counts(p, F.col("p_name"), 3).select("kmer", F.ln("n").alias("weight"))
    return models.mean_kmer_weight(p, "p_partkey", F.col("p_name"), 3, weights).select("p_partkey", F.round("mean_weight", 6).alias("mean_weight"))


def _entropy_sql() -> str:
    blocks = ", ".join(
        f"c{k} AS (SELECT p_brand, substr(p_name, CAST(i AS INT), {k}) AS w, count(*) AS n FROM part, unnest(generate_series(1, length(p_name) - {k - 1})) u(i) GROUP BY ALL), "
        f"h{k} AS (SELECT p_brand, -sum(p * log2(p)) AS h FROM (SELECT p_brand, n / sum(n) OVER (PARTITION BY p_brand) AS p FROM c{k}) GROUP BY 1)"
        for k in (1, 2, 3)
    )
    parts = ["SELECT 0 AS ord, p_brand, h AS e FROM h1"] + [f"SELECT {k}, h{k + 1}.p_brand, h{k + 1}.h - h{k}.h FROM h{k + 1} JOIN h{k} ON h{k + 1}.p_brand = h{k}.p_brand" for k in (1, 2)]
    return f"WITH {blocks}, e AS ({' UNION ALL '.join(parts)}) SELECT CAST(ord AS INT) AS markov_order, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS sd FROM e GROUP BY 1"


@query("a20_entropy", _entropy_sql())
def entropy(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_name")
    parts = [models.entropy_by_order(p, ["p_brand"], F.col("p_name"), k).select(F.lit(k).alias("markov_order"), "entropy") for k in (0, 1, 2)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("markov_order").agg(F.round(F.avg("entropy"), 6).alias("mean"), F.round(F.stddev_samp("entropy"), 6).alias("sd"))


_PWM_SQL = """
WITH t AS (SELECT rpad(upper(p_name), 8, ' ') AS s FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')),
x AS (SELECT CAST(i - 1 AS INT) AS pos, substr(s, CAST(i AS INT), 1) AS symbol, count(*) AS n FROM t, unnest(generate_series(1, 8)) u(i) GROUP BY ALL),
g AS (SELECT CAST(p AS INT) AS pos, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ ', CAST(a AS INT), 1) AS symbol FROM unnest(generate_series(0, 7)) u(p), unnest(generate_series(1, 27)) v(a)),
f AS (SELECT pos, symbol, coalesce(n, 0) + 1.0::DOUBLE AS n FROM g LEFT JOIN x USING (pos, symbol)),
m AS (SELECT pos, symbol, ln(n / sum(n) OVER (PARTITION BY pos)) AS log_p FROM f)
"""


def _matrix(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", "p_brand", F.rpad(F.upper("p_name"), 8, " ").alias("s"))
    return named, models.train_weight_matrix(named.filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")), F.col("s"), 8, ALPHABET)


@query("a24_pwm_train", _PWM_SQL + "SELECT pos, symbol, round(log_p, 6) AS log_p FROM m")
def pwm_train(spark, sf):
    return _matrix(spark, sf)[1].select("pos", "symbol", F.round("log_p", 6).alias("log_p"))


@query("m01_pwm_score", _PWM_SQL + ", d AS (SELECT p_partkey, rpad(upper(p_name), 8, ' ') AS s FROM part) SELECT p_partkey, round(sum(log_p), 6) AS score FROM d, unnest(generate_series(0, 7)) u(i) JOIN m ON m.pos = i AND m.symbol = substr(s, CAST(i + 1 AS INT), 1) GROUP BY 1")
def pwm_score(spark, sf):
    named, matrix = _matrix(spark, sf)
    # the matrix is one row of 8 x 27 cells
    scored = named.crossJoin(F.broadcast(models.matrix_map(matrix)))
    return scored.select("p_partkey", F.round(sq.weight_matrix_score(F.col("s"), F.col("matrix"), 8), 6).alias("score"))


#: Weights of the logistic query: a symbol's place in the alphabet against its position (fixed rule).
_LOGIT = "sum((instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ ', substr(s, CAST(i AS INT), 1)) - 14) * (i - 3.5) / 20.0)"


@query("m09_logistic", f"WITH d AS (SELECT p_partkey, rpad(upper(p_name), 6, ' ') AS s FROM part), x AS (SELECT p_partkey, CAST(0.5 + {_LOGIT} AS DOUBLE) AS v FROM d, unnest(generate_series(1, 6)) u(i) GROUP BY 1) SELECT p_partkey, round(v, 6) AS score, round(1 / (1 + exp(-v)), 6) AS probability FROM x")
def logistic(spark, sf):
    beta = {f"{i}:{c}": (k + 1 - 14) * (i + 1 - 3.5) / 20.0 for i in range(6) for k, c in enumerate(ALPHABET)}
    weights = F.create_map(*[F.lit(x) for kv in beta.items() for x in kv])
    s = F.rpad(F.upper("p_name"), 6, " ")
    v = F.lit(0.5) + sq.weight_matrix_score(s, weights, 6)
    return table(spark, sf, "part").select("p_partkey", v.alias("v")).select("p_partkey", F.round("v", 6).alias("score"), F.round(sq.logistic(F.col("v")), 6).alias("probability"))


@query(
    "m11_backoff",
    """
WITH c AS (SELECT c_custkey, i, substr(c_name, CAST(i AS INT), 1) AS c, CASE WHEN i > 1 THEN substr(c_name, CAST(i - 1 AS INT), 1) END AS b FROM customer, unnest(generate_series(1, length(c_name))) u(i)),
two AS (SELECT b, c, count(*) AS n2 FROM c WHERE b IS NOT NULL GROUP BY ALL), t AS (SELECT *, n2 / sum(n2) OVER (PARTITION BY b) AS p2 FROM two),
o AS (SELECT c, n / sum(n) OVER () AS p1 FROM (SELECT c, count(*) AS n FROM c GROUP BY 1))
SELECT c_custkey, round(avg(ln(CASE WHEN n2 >= 30 THEN p2 ELSE p1 END)), 6) AS score FROM c LEFT JOIN t ON c.b = t.b AND c.c = t.c JOIN o ON c.c = o.c GROUP BY 1
""",
)
def backoff(spark, sf):
    return models.backoff_score(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", F.col("c_name"), 30).select("c_custkey", F.round("score", 6).alias("score"))


@query(
    "a21_relative_entropy",
    """
WITH k AS (SELECT p_type AS g, substr(p_name, CAST(i AS INT), 2) AS kmer FROM part, unnest(generate_series(1, length(p_name) - 1)) u(i) WHERE p_type IN ('ECONOMY', 'PROMO')),
w AS (SELECT kmer, count(*) FILTER (WHERE g = 'ECONOMY') + 1.0::DOUBLE AS x, count(*) FILTER (WHERE g = 'PROMO') + 1.0::DOUBLE AS y FROM k GROUP BY 1),
p AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM w)
SELECT round(sum(p * ln(p / q)), 6) AS relative_entropy FROM p
""",
)
def relative_entropy(spark, sf):
    counts = models.kmer_counts(table(spark, sf, "part").select("p_type", "p_name"), F.col("p_name"), 2, ["p_type"])
    return models.relative_entropy(counts, "p_type", "ECONOMY", "PROMO").select(F.round("relative_entropy", 6).alias("relative_entropy"))


@query(
    "a25_chi_square",
    """
WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e, sum(n) OVER () AS t FROM j)
SELECT round(sum((n - e) * (n - e) / e) + max(t) - sum(e), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM e
""",
)
def chi_square(spark, sf):
    return models.chi_square(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus").select(F.round("chi2", 4).alias("chi2"), "df")


@query(
    "f07_trim",
    """
WITH t AS (SELECT p_partkey, p_name AS r, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a FROM part),
u AS (SELECT p_partkey, r, a, CAST(list_max(list_filter(range(0, least(length(r), length(a)) + 1), lambda i: right(r, i) = right(a, i))) AS INT) AS s FROM t WHERE a IS NOT NULL),
v AS (SELECT p_partkey, left(r, length(r) - s) AS r, left(a, length(a) - s) AS a FROM u),
w AS (SELECT *, CAST(list_max(list_filter(range(0, least(length(r), length(a)) + 1), lambda i: left(r, i) = left(a, i))) AS INT) AS p FROM v)
SELECT p_partkey, substr(r, p + 1) AS ref, substr(a, p + 1) AS alt, CAST(p AS BIGINT) AS pos FROM w
""",
)
def trim(spark, sf):
    """Common suffix, then common prefix of each part's name and the next part's."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    t = p.withColumn("other", F.lead("p_name").over(w)).filter("other is not null")
    return t.select("p_partkey", sq.trim_alleles(F.col("p_name"), F.col("other"), F.lit(0)).alias("t")).select("p_partkey", F.col("t.ref").alias("ref"), F.col("t.alt").alias("alt"), F.col("t.pos").cast("long").alias("pos"))


@query("f08_variant_kind", "SELECT p_partkey, CASE WHEN r = 1 AND a = 1 THEN 'SNP' WHEN r < a AND r <= 1 THEN 'INS' WHEN r > a AND a <= 1 THEN 'DEL' ELSE 'COMPLEX' END AS kind FROM (SELECT p_partkey, p_size % 3 AS r, CAST(floor(p_size / 3) AS INT) % 3 AS a FROM part)")
def variant_kind(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.repeat(F.lit("A"), F.col("p_size") % 3).alias("r"), F.repeat(F.lit("C"), F.floor(F.col("p_size") / 3).cast("int") % 3).alias("a"))
    return p.select("p_partkey", sq.variant_kind(F.col("r"), F.col("a")).alias("kind"))


#: Any letter of a text stands for a base by its place in the alphabet (fixed rule).
_BASES = "translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTACA')"


@query(
    "p05_first_orf",
    f"""
WITH d AS (SELECT doc_id, {_BASES} AS s FROM documents), a AS (SELECT doc_id, s, instr(s, 'ATG') AS b FROM d),
k AS (SELECT doc_id, min(i) AS i FROM a, unnest(generate_series(0, CAST(floor((length(s) - b + 1) / 3) AS BIGINT) - 1)) u(i) WHERE b > 0 AND substr(s, CAST(b + i * 3 AS BIGINT), 3) IN ('TAA', 'TAG', 'TGA') GROUP BY 1)
SELECT doc_id, CAST(b - 1 AS INT) AS start, CAST(CASE WHEN i IS NULL THEN -1 ELSE b - 1 + i * 3 END AS INT) AS stop FROM a LEFT JOIN k USING (doc_id)
""",
)
def first_orf(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(_BASES).alias("s"))
    return d.select("doc_id", sq.first_orf(F.col("s")).alias("o")).select("doc_id", F.col("o.start").alias("start"), F.col("o.stop").alias("stop"))


@query("p08_protein_identity")
def protein_identity(spark, sf):
    """Each part's protein against the next part's of its brand."""
    from ..functions.shipping import ship
    from ..operators.alignment import identity

    ship(spark)
    p = table(spark, sf, "part").select("p_partkey", "p_brand", sq.translate_codons(F.expr(_DNA)).alias("a"))
    p = p.withColumn("b", F.lead("a").over(Window.partitionBy("p_brand").orderBy("p_partkey"))).filter("b is not null")
    return p.select("p_partkey", F.round(identity(F.col("a"), F.col("b")), 6).alias("identity"))
