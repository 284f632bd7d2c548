"""Model and grammar files written from the tables and read back, examples and words that models are trained on, and individuals'
genomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import examples, models, variants
from ..sources import models as files
from .registry import query, table
from .source_queries import _path
from .training_queries import _SEQ, _seq

_CELLS = """SELECT signal, p, c, ln((count(*) FILTER (substr(w, CAST(p + 1 AS INT), 1) = c) + 1) / CAST(count(*) + 4 AS DOUBLE)) AS log_p FROM w, unnest(range(8)) u(p), (VALUES ('A'), ('C'), ('G'), ('T')) l(c) GROUP BY ALL"""


@query(
    "s20_weight_matrices",
    f"""WITH {_SEQ}, w AS (SELECT 'GT' AS signal, id, substr(s, 1, 8) AS w FROM d UNION ALL SELECT 'AG', id, substr(s, 9, 8) FROM d), m AS ({_CELLS})
SELECT id, w.signal, CASE w.signal WHEN 'GT' THEN '+' ELSE '-' END AS strand, -7.25::DOUBLE AS cutoff, 3 AS "offset", round(sum(log_p), 6) AS score FROM w JOIN m ON m.signal = w.signal AND substr(w.w, CAST(p + 1 AS INT), 1) = c GROUP BY ALL""",
)
def weight_matrices(spark, sf):
    """Two matrices trained, written to files, read back, and every part's windows scored with what the files hold."""
    seq, path = _seq(spark, sf), _path(spark, "matrices")
    at = {"GT": (1, "+"), "AG": (9, "-")}
    window = lambda signal: F.substring("s", at[signal][0], 8)
    trained = None
    for signal, (_, strand) in at.items():
        own = models.train_weight_matrix(seq, window(signal), 8, "ACGT")
        own = own.select(F.lit(signal).alias("signal"), F.lit(strand).alias("strand"), F.lit(-7.25).alias("cutoff"), F.lit(3).alias("offset"), F.lit(2).alias("consensus_length"), "pos", "symbol", "log_p")
        trained = own if trained is None else trained.unionByName(own)
    files.write_weight_matrices(trained, path, "ACGT")
    back = files.read_weight_matrices(spark, path, "ACGT")
    by = ["signal", "strand", "cutoff", "offset"]
    cell = F.struct(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("symbol")), "log_p")
    held = back.groupBy(*by).agg(F.map_from_entries(F.collect_list(cell)).alias("matrix"))  # two rows of 32 cells
    windows = seq.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), window(k).alias("w")) for k in at])).alias("x")).select("id", "x.*")
    return windows.join(held, "signal").select("id", *by, F.round(sq.weight_matrix_score(F.col("w"), F.col("matrix"), 8), 6).alias("score"))


@query("s21_transitions", "WITH c AS (SELECT concat('from', l_linenumber) AS src, concat(l_returnflag, l_linestatus) AS dst, count(*) AS n FROM lineitem GROUP BY ALL) SELECT src, dst, round(ln(n / sum(n) OVER (PARTITION BY src)), 9) AS log_p FROM c")
def transitions(spark, sf):
    """Counts of line numbers and flags as weights in a file, read back as log shares."""
    path = _path(spark, "transitions")
    counts = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("from"), F.col("l_linenumber").cast("string")).alias("src"), F.concat("l_returnflag", "l_linestatus").alias("dst")).agg(F.count("*").alias("n"))
    lines = counts.select(F.concat("src", F.lit(" -> "), "dst", F.lit(" : "), F.col("n").cast("string")).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit("# weights").alias("value"))).write.text(path)
    return files.read_transitions(spark, path).withColumn("log_p", F.round("log_p", 9))


@query(
    "s21_topology",
    """WITH e AS (SELECT DISTINCT l_returnflag AS a, concat('to', l_linestatus) AS b, concat('by', l_linenumber) AS c FROM lineitem), f AS (SELECT DISTINCT l_returnflag AS a, l_linenumber % 3 AS ph FROM lineitem WHERE l_returnflag <> 'N'),
r AS (SELECT a AS signal, b AS d, c AS aft, NULL AS bef, NULL AS ph FROM e UNION ALL SELECT b, NULL, NULL, c, NULL FROM e UNION ALL SELECT a, NULL, NULL, NULL, ph FROM f)
SELECT signal, coalesce(list_aggregate(list_sort(list(DISTINCT bef) FILTER (bef IS NOT NULL)), 'string_agg', ','), '') AS follows, coalesce(list_aggregate(list_sort(list(DISTINCT aft) FILTER (aft IS NOT NULL)), 'string_agg', ','), '') AS precedes,
coalesce(list_aggregate(list_sort(list(DISTINCT d) FILTER (d IS NOT NULL)), 'string_agg', ','), '') AS successors, coalesce(list_aggregate(list_sort(list(DISTINCT ph) FILTER (ph IS NOT NULL)), 'string_agg', ','), '0,1,2') AS phases,
CASE signal WHEN 'A' THEN '+' WHEN 'R' THEN '-' END AS strand, signal = 'A' AS coding, signal = 'N' AS enabled FROM r GROUP BY signal""",
)
def topology(spark, sf):
    l, path = table(spark, sf, "lineitem"), _path(spark, "topology")
    edges = l.select(F.concat("l_returnflag", F.lit(" -> to"), "l_linestatus", F.lit(" : by"), F.col("l_linenumber").cast("string")).alias("value")).distinct()
    phases = l.filter("l_returnflag <> 'N'").select(F.concat("l_returnflag", F.lit(" has phase "), (F.col("l_linenumber") % 3).cast("string")).alias("value")).distinct()
    other = l.select("l_returnflag").distinct().select(F.concat("l_returnflag", F.when(F.col("l_returnflag") == "A", " strand +\nA consensus coding\n# no more").when(F.col("l_returnflag") == "R", " strand -\n").otherwise(" has phase 0\nenable N\nN has phase 1\nN has phase 2")).alias("value"))
    edges.unionByName(phases).unionByName(other).write.text(path)
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return files.read_topology(spark, path).select("signal", *[flat(c) for c in ("follows", "precedes", "successors", "phases")], "strand", "coding", "enabled")


@query(
    "s21_isochores",
    f"""WITH {_SEQ}, i AS (SELECT replace(r_name, ' ', '_') AS config, r_regionkey AS k, CASE r_regionkey WHEN 0 THEN '-inf'::DOUBLE ELSE (44 + 3 * r_regionkey) / 100.0 END AS above, CASE r_regionkey WHEN 4 THEN 1.0 ELSE (47 + 3 * r_regionkey) / 100.0 END AS upto FROM region),
g AS (SELECT id, length(replace(replace(s, 'A', ''), 'T', '')) / 320.0::DOUBLE AS gc FROM d), n AS (SELECT config, count(id) AS parts FROM i LEFT JOIN g ON gc > above AND gc <= upto GROUP BY 1),
s AS (SELECT config, replace(n_name, ' ', '_') AS key, CAST(n_nationkey AS VARCHAR) AS value FROM i JOIN nation ON n_regionkey = k WHERE n_name <> 'NATION_7' UNION ALL SELECT config, 'NATION_7', 'all' FROM i UNION ALL SELECT config, 'margin', '1000' FROM i)
SELECT config, key, value, parts FROM s JOIN n USING (config)""",
)
def isochores(spark, sf):
    """Regions as isochores, their nations as settings, one of which is stated for all; with the number of parts in each isochore."""
    iso, cfg, c = _path(spark, "isochores"), _path(spark, "settings"), F.col
    region = table(spark, sf, "region").select("r_regionkey", F.replace("r_name", F.lit(" "), F.lit("_")).alias("file"))
    upto = F.when(c("r_regionkey") == 4, 100).otherwise(47 + 3 * c("r_regionkey")).cast("string")
    bounds = region.select(F.concat(F.lit("G+C <= "), upto, F.lit("% : "), "file").alias("value"))
    bounds.unionByName(spark.createDataFrame([("# isochores",), ("GLOBAL margin = 1000",), ("GLOBAL NATION_7=all",)], "value string")).write.text(iso)
    nations = table(spark, sf, "nation").join(region, c("n_regionkey") == c("r_regionkey"))
    files.write_settings(nations.select("file", F.replace("n_name", F.lit(" "), F.lit("_")).alias("key"), c("n_nationkey").cast("string").alias("value")), cfg)
    settings = files.read_isochores(spark, iso, cfg)
    ranges = settings.select("config", "above", "max_gc").distinct()
    gc = _seq(spark, sf).select((F.length(F.translate("s", "AT", "")) / F.lit(320.0)).alias("gc"))
    # a handful of ranges, of one file
    held = gc.join(F.broadcast(ranges), files.isochore_of(gc["gc"], ranges)).groupBy("config").agg(F.count("*").alias("parts"))
    out = settings.join(held, "config", "left")
    return out.select("config", "key", "value", F.coalesce("parts", F.lit(0)).alias("parts"))


#: Three transcripts a part, as exons; half of the parts lie on the other strand.
_EXONS = {"a": ((90, 120), (150, 180), (200, 230)), "b": ((90, 120), (150, 180)), "c": ((100, 160),)}


def _pieces_sql() -> str:
    """strand, transcript, class, begin on the strand, length, wanted."""
    rows = []
    for strand in "+-":
        for t, exons in _EXONS.items():
            x = list(exons) if strand == "+" else [(320 - e, 320 - b) for b, e in reversed(exons)]
            own = [("start-codon", x[0][0] - 80, 163, "ATG"), ("stop-codon", x[-1][1] - 83, 163, "TAA TAG TGA")]
            if len(x) == 1:
                own.append(("single-exon", x[0][0] + 3, x[0][1] - x[0][0] - 6, ""))
            else:
                own += [("initial-exon", x[0][0] + 3, x[0][1] - x[0][0] - 3, ""), ("final-exon", x[-1][0], x[-1][1] - x[-1][0] - 3, "")]
                own += [("internal-exon", b, e - b, "") for b, e in x[1:-1]]
                for (_, e), (b, _) in zip(x, x[1:]):
                    own += [("intron", e, b - e, ""), ("donor", e - 80, 162, "GT GC"), ("acceptor", b - 82, 162, "AG")]
            rows += [f"('{strand}', '{t}', '{c}', {at}, {n}, '{w}')" for c, at, n, w in own]
    return ", ".join(rows)


_EXAMPLES = f"""WITH {_SEQ}, o AS (SELECT id, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN p_partkey % 7 = 0 THEN replace(s, 'AAAA', 'AANA') ELSE s END AS s FROM d JOIN part ON p_partkey = id),
r AS (SELECT id, strand, CASE strand WHEN '+' THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS s FROM o),
c AS (SELECT id, transcript, class, r.strand, CAST(CASE r.strand WHEN '+' THEN at_ ELSE 320 - at_ - n END AS BIGINT) AS "begin", CAST(n AS INT) AS length, substr(s, CAST(at_ + 1 AS INT), CAST(n AS INT)) AS seq, wanted FROM r JOIN (VALUES {_pieces_sql()}) v(strand, transcript, class, at_, n, wanted) ON v.strand = r.strand),
g AS (SELECT id, min(transcript) AS transcript, class, strand, "begin", length, any_value(seq) AS seq FROM c WHERE NOT contains(seq, 'N') AND (wanted = '' OR list_contains(string_split(wanted, ' '), substr(seq, 81, CASE WHEN class LIKE '%codon' THEN 3 ELSE 2 END))) GROUP BY id, class, strand, "begin", length)"""


def _examples(spark, sf):
    parts = _seq(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    seqs = parts.select("id", F.when(F.col("id") % 7 == 0, F.replace("s", F.lit("AAAA"), F.lit("AANA"))).otherwise(F.col("s")).alias("seq"))
    of = lambda x: F.array(*[F.struct(F.lit(b).alias("begin"), F.lit(e).alias("end")) for b, e in x])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("transcript"), of(x).alias("exons")) for t, x in _EXONS.items()]))
    transcripts = parts.select("id", F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"), each.alias("t")).select("id", "strand", "t.*")
    return examples.training_examples(transcripts, seqs, "id", "transcript")


@query("m19_training_examples", f"{_EXAMPLES} SELECT * FROM g")
def training_examples(spark, sf):
    return _examples(spark, sf)


@query(
    "m19_capped_examples",
    f"""{_EXAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws(':', '1', id, class, strand, "begin", length))) AS n FROM g)
SELECT id, transcript, class, strand, "begin", length, seq FROM k WHERE n <= CASE class WHEN 'donor' THEN 50 WHEN 'acceptor' THEN 20 WHEN 'intron' THEN 30 ELSE 1000000000 END""",
)
def capped_examples(spark, sf):
    """Three classes capped, which is what the sampling is for; the others stay whole."""
    return examples.capped(_examples(spark, sf), "class", ["id", "class", "strand", "begin", "length"], {"donor": 50, "acceptor": 20, "intron": 30})


@query(
    "a22_word_bias",
    f"""WITH {_SEQ}, o AS (SELECT id, s, p_size AS z FROM d JOIN part ON p_partkey = id),
x AS (SELECT id, s, z, 20 AS b, 140 AS e FROM o WHERE z % 2 = 0 UNION ALL SELECT id, s, z, b, e FROM o, (VALUES (10, 60), (80, 130)) v(b, e) WHERE z % 2 = 1),
t AS (SELECT id, CASE WHEN z % 2 = 0 THEN substr(s, 21, 120) ELSE concat(substr(s, 11, 50), substr(s, 81, 50)) END AS r FROM o),
p AS (SELECT id, substr(r, CAST(i + 1 AS INT), 3) AS word, 1.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM t, unnest(generate_series(0, length(r) - 4)) u(i)
UNION ALL SELECT id, substr(s, CAST(b + i + 1 AS INT), 3), 0, ((b + i) * z % 11 + (b + i + 1) * z % 11 + (b + i + 2) * z % 11) / 3.0::DOUBLE FROM x, unnest(generate_series(0, e - b - 4)) u(i)),
c AS (SELECT id, word, sum(w) AS w, sum(v) AS v FROM p GROUP BY ALL), n AS (SELECT word, w / sum(w) OVER (PARTITION BY id) AS w, coalesce(v / nullif(sum(v) OVER (PARTITION BY id), 0), 0) AS v FROM c),
g AS (SELECT word, sum(w) AS w, sum(v) AS v FROM n GROUP BY 1), h AS (SELECT word, w / sum(w) OVER () AS share, v / sum(v) OVER () AS biased FROM g)
SELECT word, round(share, 8) AS share, round(biased, 8) AS biased, round(biased / share, 6) AS ratio FROM h""",
)
def word_bias(spark, sf):
    """Two transcripts a part, of which the longer one counts, under a coverage that differs by part."""
    c = F.col
    parts = _seq(spark, sf).join(table(spark, sf, "part").select(c("p_partkey").alias("id"), "p_size"), "id")
    deep = F.transform(F.sequence(F.lit(0), F.lit(319)), lambda p: (p * c("p_size") % 11).cast("double"))
    seqs = parts.select("id", c("s").alias("seq"), deep.alias("depth"))
    of = lambda *x: F.array(*[F.struct(F.lit(b).alias("begin"), e.alias("end")) for b, e in x])
    second = F.when(c("p_size") % 2 == 0, 140).when(c("p_size") % 3 == 0, 120).otherwise(100)
    both = F.array(F.struct(F.lit("a").alias("transcript"), of((10, F.lit(60)), (80, F.lit(130))).alias("exons")), F.struct(F.lit("b").alias("transcript"), of((20, second)).alias("exons")))
    transcripts = parts.select("id", F.explode(both).alias("t")).select("id", "t.*")
    out = examples.word_bias(transcripts, seqs, "id", "transcript", 3)
    return out.select("word", F.round("share", 8).alias("share"), F.round("biased", 8).alias("biased"), F.round("ratio", 6).alias("ratio"))


@query(
    "g05_individual_genomes",
    """WITH g AS (SELECT c_nationkey AS chr, (c_custkey % 40) * 8 AS pos, c_mktsegment AS sample, max(c_custkey % 3) AS h0, min(c_custkey % 3) AS h1 FROM customer GROUP BY ALL),
a AS (SELECT chr, pos, sample, hap, CASE hap WHEN 0 THEN h0 ELSE h1 END AS allele FROM g, (VALUES (0), (1)) v(hap)), q AS (SELECT DISTINCT chr, sample, hap FROM a),
s AS (SELECT s_suppkey AS gene, s_nationkey AS chr, greatest(s_suppkey % 290 - 30, 0) AS b, least(s_suppkey % 290 + 50, 320) AS e FROM supplier),
w AS (SELECT gene, s.chr, b, e, sample, hap, i FROM s JOIN q ON q.chr = s.chr, unnest(generate_series(b, e - 1)) u(i))
SELECT gene, w.sample, w.hap, b AS "begin", e AS "end", string_agg(CASE allele WHEN 1 THEN 'GG' WHEN 2 THEN 'T' ELSE substr('ACGTACGT', CAST(i % 8 + 1 AS INT), 1) END, '' ORDER BY i) AS hap_seq, CAST(count(*) FILTER (allele > 0) AS INT) AS applied
FROM w LEFT JOIN a ON a.chr = w.chr AND a.sample = w.sample AND a.hap = w.hap AND a.pos = i GROUP BY ALL""",
)
def individual_genomes(spark, sf):
    """Suppliers as genes on nations, market segments as individuals whose genotypes are customers."""
    c = F.col
    at, allele = (c("c_custkey") % 40 * 8).cast("int"), (c("c_custkey") % 3).cast("int")
    sites = table(spark, sf, "customer").groupBy(c("c_nationkey").alias("chr"), at.alias("ref_pos"), c("c_mktsegment").alias("sample")).agg(F.max(allele).alias("h0"), F.min(allele).alias("h1"))
    alleles = F.array(F.lit("A"), F.lit("GG"), F.lit("T"))
    long = sites.select("chr", "ref_pos", c("ref_pos").cast("string").alias("id"), alleles.alias("alleles"), "sample", F.posexplode(F.array("h0", "h1")).alias("hap", "allele"))
    genes = table(spark, sf, "supplier").select(c("s_suppkey").alias("gene"), c("s_nationkey").alias("chr"), (c("s_suppkey") % 290).alias("begin"), (c("s_suppkey") % 290 + 20).alias("end"))
    seqs = table(spark, sf, "nation").select(c("n_nationkey").alias("chr"), F.repeat(F.lit("ACGTACGT"), F.lit(40)).alias("seq"))
    out = variants.individual_genomes(genes, seqs, long, 30)
    return out.select("gene", "sample", "hap", "begin", "end", "hap_seq", "applied")
