"""Files of models and of the grammar around them, as long parameter tables: weight matrices, transitions, topologies and
isochores with their configurations. A folder may hold any number of model files; each is one row until it is taken apart,
and what is read stays in the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The line forms of the grammar files (fixed formats).
TRANSITION = r"^\s*(\S+)\s*->\s*(\S+)\s*:\s*(\S+)\s*$"
PHASE = r"^\s*(\S+)\s+has\s+phase\s+(\S+)\s*$"
STRAND = r"^\s*(\S+)\s+strand\s+(\S+)\s*$"
CODING = r"^\s*(\S+)\s+consensus\s+coding\s*$"
ENABLE = r"^\s*enable\s+(\S+)\s*$"
BOUNDARY = r"G\+C\s*<=\s*([0-9.]+)%\s*:\s*(\S+)"
GLOBAL = r"GLOBAL\s+(\S+)\s*=\s*(\S+)"
SETTING = r"^\s*([^\s=]+)\s*=\s*(.*?)\s*$"
#: A model's first word, and how many values stand before its cells: kind, signal, cutoff, positions, symbols, window, offset,
#: consensus, strand (fixed format).
MATRIX, HEAD = "WMM", 9


def _fail(*parts: str | Column) -> Column:
    return F.raise_error(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _file() -> Column:
    """A file's own name, or that of the folder that write_settings gave it."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/file=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract(path, r"([^/]+)$", 1))


def write_weight_matrices(models: DataFrame, path: str, alphabet: str) -> None:
    """One model a line and record of models (signal, cutoff, offset, consensus_length, strand, pos, symbol, log_p).

    Models are told apart by signal and strand. Cells run by position, then in the alphabet's order; a cell that is missing is
    an error when the file is read, not before. Numbers keep all their digits.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in alphabet]), F.col("symbol"))
    by = ["signal", "strand", "cutoff", "offset", "consensus_length"]
    cells = F.array_sort(F.collect_list(F.struct("pos", place.alias("place"), "log_p")))
    whole = models.groupBy(*by).agg(cells.alias("cells"), (F.max("pos") + 1).alias("n"))
    rows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.array_join(F.transform(F.filter("cells", lambda c: c["pos"] == p), lambda c: c["log_p"].cast("string")), "\t"))
    values, size = F.array_join(rows, "\n"), F.lit(str(len(alphabet)))
    text = F.concat_ws("\n", F.lit(MATRIX), "signal", F.concat_ws("\t", F.col("cutoff").cast("string"), F.col("n").cast("string"), size), F.concat_ws("\t", F.col("n").cast("string"), F.col("offset").cast("string"), F.col("consensus_length").cast("string")), "strand", values)
    whole.select(F.concat(text, F.lit("\n")).alias("value")).write.option("lineSep", "\n").text(path)


def read_weight_matrices(spark: SparkSession, path: str, alphabet: str) -> DataFrame:
    """signal, strand, cutoff, offset, consensus_length, pos, symbol, log_p of every matrix in the files of a folder.

    A file may hold several models; each starts at a line that is its kind. A kind other than a weight matrix, another number of
    symbols than the alphabet has, and missing, extra or unreadable cells are errors that name the model. `-inf` is a value.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=[A-Za-z]+[ \t\r]*\n[^\n]*\n[^\n]*\n[^\n]*\n[+.\-][ \t\r]*\n)")).alias("model"))
    v = raw.filter(F.col("model").rlike(r"\S")).select(F.split(F.regexp_replace("model", r"^\s+|\s+$", ""), r"\s+").alias("f"))
    at = lambda k: F.get("f", F.lit(k))
    n, wide = at(3).try_cast("int"), at(4).try_cast("int")
    cells = F.transform(F.slice("f", F.lit(HEAD + 1), F.greatest(F.size("f") - HEAD, F.lit(0))), lambda x: x.try_cast("double"))
    checked = (
        F.when(at(0) != MATRIX, _fail("not a weight matrix: ", at(0)).cast("array<double>"))
        .when(~F.coalesce(wide == len(alphabet), F.lit(False)), _fail("other symbols than the alphabet's: ", at(1)).cast("array<double>"))
        .when(~F.coalesce((F.size(cells) == n * wide) & F.forall(cells, lambda x: x.isNotNull()), F.lit(False)), _fail("not a number for each cell: ", at(1)).cast("array<double>"))
        .otherwise(cells)
    )
    size = len(alphabet)
    head = [at(1).alias("signal"), at(8).alias("strand"), at(2).try_cast("double").alias("cutoff"), at(6).try_cast("int").alias("offset"), at(7).try_cast("int").alias("consensus_length")]
    each = v.select(*head, F.posexplode(checked).alias("i", "log_p"))
    symbol = F.substring(F.lit(alphabet), (F.col("i") % size + 1).cast("int"), F.lit(1))
    return each.select("signal", "strand", "cutoff", "offset", "consensus_length", F.floor(F.col("i") / size).cast("int").alias("pos"), symbol.alias("symbol"), "log_p")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are neither blank nor comments."""
    return spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, log_p of lines `A -> B : weight`: the log share of a source's weights. Of a repeated pair, whose order in a folder
    isn't defined, the greatest weight counts; weight 0 has log_p -inf. A line of another form is an error."""
    part = lambda k: F.regexp_extract("value", TRANSITION, k)
    weight = F.coalesce(part(3).try_cast("double"), _fail("syntax error in transitions: ", F.col("value")).cast("double"))
    pairs = _lines(spark, path).select(part(1).alias("src"), part(2).alias("dst"), weight.alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("src"))
    return pairs.select("src", "dst", F.when(share > 0, F.ln(share)).otherwise(F.lit(float("-inf"))).alias("log_p"))


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """One row a signal: follows and precedes (the contents that may come before and after it), successors, phases (all three if
    none is named), strand, coding and enabled. A line of another form is an error."""
    v = F.col("value")
    part = lambda p, k: F.regexp_extract("value", p, k)
    kind = F.when(v.rlike(TRANSITION), "edge").when(v.rlike(PHASE), "phase").when(v.rlike(STRAND), "strand").when(v.rlike(CODING), "coding").when(v.rlike(ENABLE), "enabled").otherwise(_fail("syntax error in topology: ", v))
    lines = _lines(spark, path).select("value", kind.alias("kind"))
    own = F.struct(
        F.when(F.col("kind") == "edge", part(TRANSITION, 1)).when(F.col("kind") == "phase", part(PHASE, 1)).when(F.col("kind") == "strand", part(STRAND, 1)).when(F.col("kind") == "coding", part(CODING, 1)).otherwise(part(ENABLE, 1)).alias("signal"),
        F.when(F.col("kind") == "edge", part(TRANSITION, 2)).alias("dst"), F.when(F.col("kind") == "edge", part(TRANSITION, 3)).alias("after"), F.lit(None).cast("string").alias("before"),
        F.when(F.col("kind") == "phase", part(PHASE, 2).try_cast("int")).alias("phase"), F.when(F.col("kind") == "strand", F.substring(part(STRAND, 2), 1, 1)).alias("strand"),
        (F.col("kind") == "coding").alias("coding"), (F.col("kind") == "enabled").alias("enabled"),
    )
    none = F.lit(None).cast("string")
    other = F.struct(part(TRANSITION, 2).alias("signal"), none.alias("dst"), none.alias("after"), part(TRANSITION, 3).alias("before"), F.lit(None).cast("int").alias("phase"), none.alias("strand"), F.lit(False).alias("coding"), F.lit(False).alias("enabled"))
    rows = lines.select(F.explode(F.when(F.col("kind") == "edge", F.array(own, other)).otherwise(F.array(own))).alias("r")).select("r.*")
    set_of = lambda c: F.array_sort(F.collect_set(c))
    found = rows.groupBy("signal").agg(
        set_of("before").alias("follows"), set_of("after").alias("precedes"), set_of("dst").alias("successors"), set_of("phase").alias("phases"),
        F.max("strand").alias("strand"), F.max("coding").alias("coding"), F.max("enabled").alias("enabled"),
    )
    return found.withColumn("phases", F.when(F.size("phases") == 0, F.array(*[F.lit(k) for k in range(3)])).otherwise(F.col("phases")))


def write_settings(df: DataFrame, path: str) -> None:
    """file, key, value as one folder `file=<name>` a file."""
    df.select("file", F.concat_ws(" = ", "key", "value").alias("line")).repartition("file").write.partitionBy("file").text(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of `key = value` lines; what follows a # is a comment. Of a key that a file repeats the last line counts."""
    # a file's settings are a page at most; its lines are numbered within it
    whole = spark.read.text(path, wholetext=True).select(_file().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    stated = whole.withColumn("value", F.regexp_replace("value", "#.*$", "")).filter(F.col("value").rlike(SETTING))
    pairs = stated.select("file", "line", F.regexp_extract("value", SETTING, 1).alias("key"), F.regexp_extract("value", SETTING, 2).alias("value"))
    return pairs.groupBy("file", "key").agg(F.max(F.struct("line", "value")).alias("last")).select("file", "key", "last.value")


def read_isochores(spark: SparkSession, path: str, configurations: str) -> DataFrame:
    """max_gc (a share), above (the boundary below it, or -inf), config, key, value: each isochore's settings, those that the isochore
    file states as GLOBAL before its configuration's own. A line of another form, or a configuration that isn't there, is an error."""
    v = F.col("value")
    kind = F.when(v.rlike(BOUNDARY), "boundary").when(v.rlike(GLOBAL), "global").otherwise(_fail("syntax error in isochores: ", v))
    lines = _lines(spark, path).select("value", kind.alias("kind"))
    bounds = lines.filter("kind = 'boundary'").select((F.regexp_extract("value", BOUNDARY, 1).cast("double") / 100).alias("max_gc"), F.regexp_extract("value", BOUNDARY, 2).alias("config"))
    # isochores are a handful, whatever the data: one ordered list of them
    listed = bounds.agg(F.array_sort(F.collect_list(F.struct("max_gc", "config"))).alias("all"))
    each = listed.select("all", F.posexplode("all").alias("i", "b")).select("b.max_gc", F.when(F.col("i") > 0, F.get("all", F.col("i") - 1)["max_gc"]).otherwise(F.lit(float("-inf"))).alias("above"), "b.config")
    settings = read_settings(spark, configurations)
    known = settings.select(F.col("file").alias("config")).distinct().withColumn("known", F.lit(True))
    each = each.join(known, "config", "left").withColumn("config", F.when(F.col("known"), F.col("config")).otherwise(_fail("no such configuration: ", F.col("config")))).drop("known")
    over = lines.filter("kind = 'global'").select(F.regexp_extract("value", GLOBAL, 1).alias("key"), F.regexp_extract("value", GLOBAL, 2).alias("value"))
    over = over.groupBy("key").agg(F.max("value").alias("value"))
    own = each.join(settings.withColumnRenamed("file", "config"), "config").join(over.select("key"), "key", "left_anti")
    cols = ["max_gc", "above", "config", "key", "value"]
    return own.select(*cols).unionByName(each.crossJoin(F.broadcast(over)).select(*cols))  # settings of one file


def isochore_of(gc: Column, isochores: DataFrame) -> Column:
    """Whether a row's share of G and C lies in an isochore's range (above, max_gc]; the join condition of sequences and isochores."""
    return (gc > isochores["above"]) & (gc <= isochores["max_gc"])
