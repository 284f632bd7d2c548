"""Splice graphs of many transcripts as two tables, and what variants do to them.

vertices: key, kind (LT, TSS, GT, AG, TES, RT), begin, end. edges: key, src, dst, kind (exon, intron, intergenic), begin,
end, change, annotated; a vertex is named '<kind>@<begin>', an edge runs from its source's end to its target's begin.
Positions are 0-based and half open, on the forward strand of the altered sequence. Edits are joins by key that return new
edges, so any of them can be unioned; what goes along whole paths takes one row a transcript, with its edges in an array.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.dealing import PART_ROWS, dealt
from ..functions.shipping import ship
from .scores import posterior
from .splicing import QUEUE

#: Bases of a splice site's consensus (fixed value).
SITE = 2
#: Bases on either side of a variant within which exon definition is compared (fixed value).
AROUND = 5
#: Likelihood ratios below and above which exon definition is weakened and strengthened (fixed values).
WEAKER, STRONGER = 0.5, 2.0
#: Bases at the begin of an edge that its score leaves out (fixed value).
OFFSET = 6


def together(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key once. What is grouped or joined by key and more then stays where it is: the setting lets joins use
    rows that are dealt out by some of their keys alone. The number of parts is given, since all later work is done on these
    few bytes, and parts that are merged for their size would leave it to a few tasks. It grows with the rows."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return dealt(df, key, rows=PART_ROWS)


def name(kind: Column, begin: Column) -> Column:
    return F.concat(kind, F.lit("@"), begin.cast("string"))


def annotated_chain(transcripts: DataFrame, key: str, exons: str, length: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) LT, TSS, (GT, AG)*, TES, RT of each transcript; one with an intron too short for both sites, or whose
    exons overlap, has no graph. exons: array<struct<begin, end>> in order."""
    c, x = F.col, F.col(exons)
    apart = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: b["begin"] - a["end"] >= 2 * SITE)
    whole = transcripts.filter((F.size(x) > 0) & F.forall(apart, lambda ok: ok)).select(key, x.alias("x"), c(length).cast("int").alias("l"), F.posexplode(x).alias("at", "own"))
    near = lambda step, field: F.when(c("at") + step >= 0, F.get("x", c("at") + step)[field]).cast("int")
    rows = whole.select(key, "l", c("own")["begin"].cast("int").alias("b"), c("own")["end"].cast("int").alias("e"), near(-1, "end").alias("pe"), near(1, "begin").alias("nb"))
    first, last = c("pe").isNull(), c("nb").isNull()
    v = lambda kind, b, n: F.struct(F.lit(kind).alias("kind"), b.alias("begin"), (b + n).alias("end"))
    vertices = F.array_compact(F.array(
        F.when(first, v("LT", F.lit(0), 0)), F.when(first, v("TSS", c("b"), 0)), F.when(~first, v("AG", c("b") - SITE, SITE)),
        F.when(~last, v("GT", c("e"), SITE)), F.when(last, v("TES", c("e"), 0)), F.when(last, v("RT", c("l"), 0)),
    ))
    at = lambda kind, p: name(F.lit(kind), p)
    way = lambda kind, src, dst, b, e: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), b.alias("begin"), e.alias("end"))
    left, right = F.when(first, at("TSS", c("b"))).otherwise(at("AG", c("b") - SITE)), F.when(last, at("TES", c("e"))).otherwise(at("GT", c("e")))
    edges = F.array_compact(F.array(
        F.when(first, way("intergenic", F.lit("LT@0"), left, F.lit(0), c("b"))), way("exon", left, right, c("b"), c("e")),
        F.when(~last, way("intron", right, at("AG", c("nb") - SITE), c("e") + SITE, c("nb") - SITE)), F.when(last, way("intergenic", right, at("RT", c("l")), c("e"), c("l"))),
    ))
    return rows.select(key, F.inline(vertices)), rows.select(key, F.inline(edges)).select("*", F.lit("").alias("change"), F.lit(True).alias("annotated"))


def _made(df: DataFrame, key: str, src: str, dst: str, kind: str, begin: str, end: str, change: str) -> DataFrame:
    """New edges, each once; one that would run backwards is none."""
    out = df.filter(F.col(begin) <= F.col(end)).select(key, F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.col(begin).alias("begin"), F.col(end).alias("end"))
    return out.distinct().select("*", F.lit(change).alias("change"), F.lit(False).alias("annotated"))


def _around(edges: DataFrame, broken: DataFrame, key: str, middle: str, outer: str) -> DataFrame:
    """Annotated `middle` edges with a broken vertex at an end, and their neighbours of kind `outer`: columns l_, m_, r_ of three
    edges in a row, of which the one beyond the broken vertex is annotated too and the other one any.

    A transcript's edges and broken vertices meet in arrays by one grouping; nothing is joined or sorted.
    """
    one = F.struct("src", "dst", "kind", "begin", "end", "annotated")
    own = edges.filter(F.col("kind").isin(middle, outer)).select(key, one.alias("e"), F.lit(None).cast("string").alias("v"))
    both = own.unionByName(broken.select(key, F.lit(None).cast(own.schema["e"].dataType).alias("e"), "v"))
    graphs = both.groupBy(key).agg(F.collect_list("e").alias("all"), F.collect_set("v").alias("lost")).filter(F.size("lost") > 0)
    lost = lambda v: F.array_contains("lost", v)
    ways = lambda there: F.explode(F.filter("all", lambda e: (e["kind"] == outer) & there(e)))
    hit = graphs.select(key, "all", "lost", F.explode(F.filter("all", lambda e: e["annotated"] & (e["kind"] == middle))).alias("m"))
    hit = hit.select(key, "all", "m", lost(F.col("m.src")).alias("left"), lost(F.col("m.dst")).alias("right")).filter("left or right")
    met = hit.select(key, "all", "m", "left", "right", ways(lambda e: (e["dst"] == F.col("m.src")) & (F.col("right") | e["annotated"])).alias("l"))
    met = met.select(key, "m", "l", "left", "right", ways(lambda e: (e["src"] == F.col("m.dst")) & (F.col("left") | e["annotated"])).alias("r"))
    met = met.filter("(right and r.annotated) or (left and l.annotated)")
    return met.select(key, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "lmr" for c in ("src", "dst", "begin", "end")])


def skipping_edges(edges: DataFrame, broken: DataFrame, key: str) -> DataFrame:
    """Introns across each exon one of whose sites is broken (key, v). The intron beyond the broken site is the annotated one;
    on the exon's other side every intron of the graph is joined."""
    return _made(_around(edges, broken, key, "exon", "intron"), key, "l_src", "r_dst", "intron", "l_begin", "r_end", "exon-skipping")


def retention_edges(edges: DataFrame, broken: DataFrame, key: str, most: int) -> DataFrame:
    """Exons across each intron one of whose sites is broken, of at most `most` bases."""
    across = _around(edges, broken, key, "intron", "exon").filter(F.col("r_end") - F.col("l_begin") <= most)
    return _made(across, key, "l_src", "r_dst", "exon", "l_begin", "r_end", "intron-retention")


def _overlap(v: Column, x: Column) -> Column:
    return (v["vb"] < x["end"]) & (v["ve"] > x["begin"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body (an array) of a value that is worked out once: a lambda's variable holds it."""
    return F.flatten(F.transform(F.array(value), body))


def _each(rows: Column, body: Callable[[Column], Column]) -> Column:
    """The elements of body's arrays, by element of rows."""
    return F.flatten(F.transform(rows, body))


def _edge(src: Column, dst: Column, kind: str | Column, begin: Column, end: Column, change: str, side: str = "") -> Column:
    named = {"src": src, "dst": dst, "kind": F.lit(kind) if isinstance(kind, str) else kind, "begin": begin, "end": end, "change": F.lit(change), "side": F.lit(side)}
    return F.struct(*[v.alias(c) for c, v in named.items()])


def _new_edges(graphs: DataFrame, key: str, made: Column) -> DataFrame:
    """The edges of made (array of _edge) by transcript, each once a side; one that would run backwards is none. Outer, since
    Spark would else work out every array twice, once to see whether it is empty."""
    flat = graphs.select(key, F.inline_outer(made)).filter(F.col("begin") <= F.col("end"))
    return flat.distinct().drop("side").select("*", F.lit(False).alias("annotated"))


def graph_rows(key: str, edges: DataFrame, vertices: DataFrame, sites: DataFrame, **more: DataFrame) -> DataFrame:
    """One row a transcript: its edges and vertices, sites that aren't vertices yet (each once, named v, with their end), and by
    name the rows of more, in arrays of structs of all their columns but key, each once.

    All meet by one grouping, so that nothing is joined or sorted again for what is looked up along a transcript. Sites are
    held against vertices one by one: a transcript costs their product.
    """
    of = lambda df, *columns: df.select(key, F.struct(*columns).alias("one"))
    parts = {"edges": of(edges, "src", "dst", "kind", "begin", "end", "annotated"), "vertices": of(vertices, "kind", "begin", "end"), "sites": of(sites, "kind", F.col("begin").cast("int").alias("begin"))}
    parts |= {n: of(df, *[c for c in df.columns if c != key]) for n, df in more.items()}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumnRenamed("one", n) for n, df in parts.items()])
    lists = [(F.collect_list if n in ("edges", "vertices") else F.collect_set)(n).alias(n) for n in parts]
    graphs = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*lists)
    fresh = F.filter("sites", lambda s: ~F.exists("vertices", lambda v: (v["kind"] == s["kind"]) & (v["begin"] == s["begin"])))
    named = F.transform(fresh, lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), (s["begin"] + SITE).alias("end"), name(s["kind"], s["begin"]).alias("v")))
    return graphs.withColumn("sites", named)


def cryptic_exons(vertices: DataFrame, edges: DataFrame, new: DataFrame, sites: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) that complete a new splice site inside an annotated intron to an exon of at most `most` bases.

    A new donor takes every acceptor among `sites` before it, a new acceptor every donor after it, both within the intron and
    wholly within `most` bases of the new site. The mate is joined to the new site by the exon, and to the annotated site of the
    intron's far side by an intron. Sites that are vertices already are no mates. new, sites: key, kind, begin.
    """
    graphs = graph_rows(key, edges, vertices, sites, new=new.select(key, "kind", F.col("begin").cast("int").alias("begin")))


    def met(g: Column, side: str, build: Callable[[Column, Column, Column], Column]) -> Column:
        """build of the new site, its intron and its mate, for all that meet; side: kind of the new site."""
        end = lambda n: n["begin"] + SITE
        near = {
            "GT": lambda n, i, m: (m["kind"] == "AG") & (m["begin"] >= F.greatest(i["begin"], n["begin"] - most)) & (m["end"] <= n["begin"]),
            "AG": lambda n, i, m: (m["kind"] == "GT") & (m["begin"] >= end(n)) & (m["end"] <= F.least(i["end"], end(n) + most)),
        }[side]
        inside = lambda n: F.filter(g["edges"], lambda i: i["annotated"] & (i["kind"] == "intron") & (n["begin"] >= i["begin"]) & (end(n) <= i["end"]))
        own = F.filter(g["new"], lambda n: n["kind"] == side)
        return _each(own, lambda n: _each(inside(n), lambda i: _each(F.filter(g["sites"], lambda m: near(n, i, m)), lambda m: build(n, i, m))))

    site = lambda n: name(n["kind"], n["begin"])
    mate = lambda n, i, m: F.array(F.struct(m["kind"].alias("kind"), m["begin"].alias("begin"), m["end"].alias("end")))
    before = lambda g: met(g, "GT", lambda n, i, m: F.array(
        _edge(m["v"], site(n), "exon", m["end"], n["begin"], "cryptic-exon", "before"), _edge(i["src"], m["v"], "intron", i["begin"], m["begin"], "", "before")))
    after = lambda g: met(g, "AG", lambda n, i, m: F.array(
        _edge(site(n), m["v"], "exon", n["begin"] + SITE, m["begin"], "cryptic-exon", "after"), _edge(m["v"], i["dst"], "intron", m["end"], i["end"], "", "after")))
    row = F.struct("edges", "sites", "new")
    found = graphs.select(key, F.inline_outer(_let(row, lambda g: F.array_distinct(F.concat(met(g, "GT", mate), met(g, "AG", mate))))))
    return found.filter("begin is not null"), _new_edges(graphs, key, _let(row, lambda g: F.concat(before(g), after(g))))


def _prefix(arrays: pa.Array) -> tuple:
    """(prefix sums of each list, where each list's begin, its size)."""
    import numpy as np

    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    size = arrays.value_lengths().fill_null(0).to_numpy()
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.zeros(starts[-1])
    for lo, n, at in zip((np.cumsum(size) - size).tolist(), size.tolist(), starts.tolist(), strict=False):
        np.cumsum(flat[lo : lo + n], out=out[at + 1 : at + 1 + n])
    return out, starts, size


def prefix_tracks(df: DataFrame, key: str, values: str, track: str) -> DataFrame:
    """key and track: prefix sums of values (array<double>), one longer and 0 at first; a null array has none."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, starts, _ = _prefix(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out), mask=batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, track])

    ship(df.sparkSession)
    return df.select(key, F.col(values).cast("array<double>")).mapInArrow(sums, f"{key} {df.schema[key].dataType.simpleString()}, {track} array<double>")


def sums_by_graph(windows: DataFrame, sequences: DataFrame, key: str, begin: str, end: str, tracks: dict[str, Column]) -> DataFrame:
    """key and rows: array of the structs of windows (every column but key) with, by name of the track, the sum over [begin, end).

    tracks: array<double> of values by position, made from columns of sequences (a row a key). Windows meet their sequence
    as one row, and tracks are made beside it, so that no track is ever shuffled or sorted. Null where a track doesn't reach.
    """
    fields = [c for c in windows.columns if c != key]
    grouped = windows.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("rows"))
    wide = grouped.join(sequences, key).select(key, "rows", *[v.cast("array<double>").alias(t) for t, v in tracks.items()])
    names = [*fields, *tracks]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            own, rows = batch.column(1), batch.column(1).flatten()
            count = own.value_lengths().to_numpy()
            graph = np.repeat(np.arange(len(count)), count)
            b, e = (rows.field(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in (begin, end))
            found = []
            for k in range(len(names) - len(fields)):
                out, starts, size = _prefix(batch.column(2 + k))
                there = (b >= 0) & (e >= 0) & (b <= size[graph]) & (e <= size[graph]) & ~batch.column(2 + k).is_null().to_numpy(zero_copy_only=False)[graph]
                at = lambda p: out[np.where(there, starts[graph] + p, 0)]  # noqa: B023, E731
                found.append(pa.array(at(e) - at(b), mask=~there))
            structs = pa.StructArray.from_arrays([*rows.flatten(), *found], names=names)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "rows"])

    ship(windows.sparkSession)
    kinds = ",".join([f"`{c}`:{windows.schema[c].dataType.simpleString()}" for c in fields] + [f"`{t}`:double" for t in tracks])
    return wide.mapInArrow(sums, f"{key} {windows.schema[key].dataType.simpleString()}, rows array<struct<{kinds}>>")


def interval_score(track: Column, begin: Column, end: Column) -> Column:
    """The sum over [begin, end) from prefix sums; null where the track doesn't reach."""
    at = lambda p: F.when(p >= 0, F.get(track, p))
    return at(end) - at(begin)


def definition_change(windows: DataFrame, tracks: DataFrame, key: str, begin: str, end: str, cigar: str | None = None) -> DataFrame:
    """windows with ratio: exon definition per base in the altered sequence over that in the reference.

    tracks: key, ref and alt (prefix sums of log scores) and, where their positions differ, a column `cigar` that aligns
    reference to altered sequence, read backwards. Windows outside a track have a null ratio.
    """
    b, e = F.col(begin), F.col(end)
    rb, re = b, e
    if cigar:
        turned = F.transform(sq.cigar_segments(F.col(cigar)), lambda s: F.struct(s["op"].alias("op"), s["n"].alias("n"), s["alt"].alias("ref"), s["ref"].alias("alt")))
        rb, re = sq.map_position(turned, b), sq.map_position(turned, e)
    change = interval_score(F.col("alt"), b, e) / (e - b) - interval_score(F.col("ref"), rb, re) / F.nullif(re - rb, F.lit(0))
    return windows.join(tracks, key).withColumn("ratio", F.exp(change)).drop("ref", "alt", *([cigar] if cigar else []))


class Regulation:
    """Edits of a graph by variants (key, vb, ve) that change exon definition near them.

    sites: (key, kind, begin) candidates that score their cutoff. shift: how far an end may move; most: the longest cryptic
    exon; least_intron: the shortest intron; least_ratio: the least exon track sum of a cryptic exon.

    values: ref and alt, values by position made from columns of tracks (a row a key), where positions don't differ; else tracks
    holds prefix sums under these names. Windows are as short as a variant or a cryptic exon, so values are summed as they are.
    A transcript is one row (graph_rows), in which all of an edit is looked up; only new edges leave it.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, variants: DataFrame, sites: DataFrame, tracks: DataFrame, key: str, shift: int, cigar: str | None = None, values: dict[str, Column] | None = None):
        self.key, self.shift = key, shift
        variants = variants.select(key, F.col("vb").cast("int").alias("vb"), F.col("ve").cast("int").alias("ve"))
        graphs = graph_rows(key, edges, vertices, sites, variants=variants, tracks=tracks)
        fields = [c for c in tracks.columns if c != key]
        # a transcript without tracks has no change of exon definition
        self.graphs = graphs.select(*[c for c in graphs.columns if c != "tracks"], F.inline("tracks").alias(*fields))
        self.values, self.cigar = values, cigar

    def _built(self, body: Callable[[Column], Column]) -> DataFrame:
        """The edges that body makes of a graph, a struct of a row's arrays."""
        annotated = lambda kind: F.filter("edges", lambda e: e["annotated"] & (e["kind"] == kind)).alias(f"{kind}s")
        graph = F.struct("edges", "vertices", "sites", "variants", annotated("exon"), annotated("intron"))
        return _new_edges(self.graphs, self.key, _let(graph, body))

    def _judged(self, met: Column, window: Callable[[Column], tuple[Column, Column]], keep: Callable[[Column], Column], then: Callable[[Column, Column], Column]) -> Column:
        """then of the tracks and of the elements of met whose ratio in their window is one to keep. Tracks are only made where
        something is met."""
        kept = lambda t, c: F.filter(c, lambda m: keep(self._ratio(t, *window(m))))
        return _let(met, lambda c: F.when(F.size(c) > 0, _let(self._tracks(), lambda t: then(t, kept(t, c)))))

    def _tracks(self) -> Column:
        made = self.values or {c: F.col(c) for c in ("ref", "alt")}
        columns = [made[c].cast("array<double>").alias(c) for c in ("ref", "alt")]
        if self.cigar:
            turned = F.transform(sq.cigar_segments(F.col(self.cigar)), lambda s: F.struct(s["op"].alias("op"), s["n"].alias("n"), s["alt"].alias("ref"), s["ref"].alias("alt")))
            columns.append(turned.alias("turned"))
        return F.struct(*columns)

    def _sum(self, track: Column, begin: Column, end: Column) -> Column:
        """The track's sum over [begin, end); null where it doesn't reach."""
        if not self.values:
            return interval_score(track, begin, end)
        there = (begin >= 0) & (begin <= end) & (end <= F.size(track))
        return F.when(there, F.aggregate(F.slice(track, begin + 1, end - begin), F.lit(0.0), lambda a, v: a + v))

    def _ratio(self, t: Column, begin: Column, end: Column) -> Column:
        """Exon definition per base in the altered sequence over that in the reference."""
        rb, re = (sq.map_position(t["turned"], p) for p in (begin, end)) if self.cigar else (begin, end)
        change = self._sum(t["alt"], begin, end) / F.nullif(end - begin, F.lit(0)) - self._sum(t["ref"], rb, re) / F.nullif(re - rb, F.lit(0))
        return F.when(end > begin, F.exp(change))

    def _inside(self, g: Column, only: Callable[[Column, Column], Column], then: Callable[[Column], Column]) -> Column:
        """then of the variants v and the exons x that they overlap and weaken, measured inside them."""
        met = _each(g["variants"], lambda v: F.transform(F.filter(g["exons"], lambda x: _overlap(v, x) & only(v, x)), lambda x: F.struct(v.alias("v"), x.alias("x"))))
        window = lambda m: (F.greatest(m["v"]["vb"] - AROUND, m["x"]["begin"]), F.least(m["v"]["ve"] + AROUND, m["x"]["end"]))
        return self._judged(met, window, lambda ratio: ratio < WEAKER, lambda t, kept: then(kept))

    def _outside(self, g: Column) -> Column:
        """Variants that overlap no annotated exon."""
        return F.filter(g["variants"], lambda v: ~F.exists(g["exons"], lambda x: _overlap(v, x)))

    def weakened(self) -> DataFrame:
        """Introns that skip a weakened exon between two splice sites: from every donor back to the annotated one before it, to
        every acceptor up to the annotated one after. A variant counts for the first exon it overlaps."""
        donors = lambda g, i, x: F.filter(g["vertices"], lambda d: (d["kind"] == "GT") & (d["end"] >= i["begin"]) & (d["end"] <= x["begin"]))
        acceptors = lambda g, i, x: F.filter(g["vertices"], lambda a: (a["kind"] == "AG") & (a["begin"] >= x["end"]) & (a["begin"] <= i["end"]))
        across = lambda d, a: _edge(name(d["kind"], d["begin"]), name(a["kind"], a["begin"]), "intron", d["end"], a["begin"], "exon-skipping")
        first = lambda g, v, x: ~F.exists(g["exons"], lambda y: _overlap(v, y) & (y["begin"] < x["begin"]))

        def skips(g: Column, x: Column) -> Column:
            into, out = F.filter(g["introns"], lambda i: i["dst"] == x["src"]), F.filter(g["introns"], lambda i: i["src"] == x["dst"])
            return _each(into, lambda i: _each(out, lambda o: _each(donors(g, i, x), lambda d: F.transform(acceptors(g, o, x), lambda a: across(d, a)))))

        weak = lambda kept: F.array_distinct(F.transform(kept, lambda m: m["x"]))
        return self._built(lambda g: self._inside(g, lambda v, x: first(g, v, x), lambda kept: _each(weak(kept), lambda x: skips(g, x))))

    def _moved(self, g: Column, old: Column, to: Column) -> Column:
        """Edges that give an exon's end another site: those of the old end, from or to the new one."""
        kinds = lambda e: e["kind"].isin("exon", "intron")
        out = F.filter(g["edges"], lambda e: kinds(e) & (e["src"] == old) & (to["end"] < e["end"]))
        into = F.filter(g["edges"], lambda e: kinds(e) & (e["dst"] == old) & (e["begin"] < to["begin"]))
        return F.concat(
            F.transform(out, lambda e: _edge(to["v"], e["dst"], e["kind"], to["end"], e["end"], "regulatory")), F.transform(into, lambda e: _edge(e["src"], to["v"], e["kind"], e["begin"], to["begin"], "regulatory"))
        )

    def _near(self, g: Column, kind: str, lo: Column, hi: Column) -> Column:
        return F.filter(g["sites"], lambda s: (s["kind"] == kind) & (s["begin"] >= lo) & (s["begin"] < hi))

    def shortened(self) -> DataFrame:
        """A variant near an exon's end (the right one if as near) that weakens it: the end moves to a site inside the exon,
        between it and the variant's far side."""
        to_right, to_left = lambda v, x: x["end"] - v["vb"], lambda v, x: v["ve"] - x["begin"]

        def moved(g: Column, v: Column, x: Column) -> Column:
            right = _each(self._near(g, "GT", x["end"] - self.shift, v["vb"]), lambda s: self._moved(g, x["dst"], s))
            left = _each(self._near(g, "AG", v["ve"], x["begin"] + self.shift), lambda s: self._moved(g, x["src"], s))
            return F.when(to_right(v, x) <= to_left(v, x), right).otherwise(left)

        close = lambda v, x: F.least(to_right(v, x), to_left(v, x)) <= self.shift
        return self._built(lambda g: self._inside(g, close, lambda kept: _each(kept, lambda m: moved(g, m["v"], m["x"]))))

    def extended(self) -> DataFrame:
        """A variant beside an exon that strengthens what lies there: the end moves out to a site beyond the variant."""
        before = lambda v, x: v["ve"] <= x["begin"]
        near = lambda v, x: F.when(before(v, x), x["begin"] - v["ve"]).otherwise(v["vb"] - x["end"]) <= self.shift

        def window(m: Column) -> tuple[Column, Column]:
            v, x = m["v"], m["x"]
            begin = F.when(before(v, x), v["vb"] - AROUND).otherwise(F.greatest(v["vb"] - AROUND, x["end"]))
            return begin, F.when(before(v, x), F.least(v["ve"] + AROUND, x["begin"])).otherwise(v["ve"] + AROUND)

        def moved(g: Column, v: Column, x: Column) -> Column:
            left = _each(self._near(g, "AG", x["begin"] - self.shift, v["vb"]), lambda s: self._moved(g, x["src"], s))
            right = _each(self._near(g, "GT", v["ve"], x["end"] + self.shift), lambda s: self._moved(g, x["dst"], s))
            return F.when(before(v, x), left).otherwise(right)

        met = lambda g: _each(self._outside(g), lambda v: F.transform(F.filter(g["exons"], lambda x: near(v, x)), lambda x: F.struct(v.alias("v"), x.alias("x"))))
        return self._built(lambda g: self._judged(met(g), window, lambda ratio: ratio > STRONGER, lambda t, kept: _each(kept, lambda m: moved(g, m["v"], m["x"]))))

    def deep_intronic(self, most: int, least_intron: int, least_ratio: float) -> DataFrame:
        """A variant deep in an intron that strengthens exon definition: cryptic exons around it, with their introns.

        The variant lies `least_intron` or more from both ends, its window within the intron. Acceptors before and donors after
        it, each within `most` bases of it, make exons of at most `most` bases whose track sum is least_ratio or more; introns
        of `least_intron` or more join them to every donor and acceptor of the graph in the same intron, ends included.
        """
        margin = max(least_intron, AROUND)
        deep = lambda v, i: (v["vb"] - i["begin"] >= margin) & (i["end"] - v["ve"] >= margin)
        met = lambda g: _each(self._outside(g), lambda v: F.transform(F.filter(g["introns"], lambda i: deep(v, i)), lambda i: F.struct(v.alias("v"), i["begin"].alias("lo"), i["end"].alias("hi"))))

        def exons(g: Column, t: Column, m: Column) -> Column:
            v = m["v"]
            fits = lambda a, d: (d["begin"] - a["end"] <= most) & (d["begin"] >= a["end"]) & (self._sum(t["alt"], a["end"], d["begin"]) >= least_ratio)
            mates = lambda a: F.filter(self._near(g, "GT", v["ve"], v["ve"] + most), lambda d: fits(a, d))
            return _each(self._near(g, "AG", v["vb"] - most, v["vb"]), lambda a: F.transform(mates(a), lambda d: F.struct(a.alias("a"), d.alias("d"), m["lo"].alias("lo"), m["hi"].alias("hi"))))

        own = lambda g, kind, x: F.filter(g["vertices"], lambda w: (w["kind"] == kind) & (w["end"] >= x["lo"]) & (w["begin"] <= x["hi"]))

        def edges(g: Column, x: Column) -> Column:
            a, d = x["a"], x["d"]
            before = F.filter(own(g, "GT", x), lambda w: a["begin"] - w["end"] >= least_intron)
            after = F.filter(own(g, "AG", x), lambda w: w["begin"] - d["end"] >= least_intron)
            return F.concat(
                F.array(_edge(a["v"], d["v"], "exon", a["end"], d["begin"], "cryptic-exon")),
                F.transform(before, lambda w: _edge(name(w["kind"], w["begin"]), a["v"], "intron", w["end"], a["begin"], "regulatory")),
                F.transform(after, lambda w: _edge(d["v"], name(w["kind"], w["begin"]), "intron", d["end"], w["begin"], "regulatory")),
            )

        window = lambda m: (m["v"]["vb"] - AROUND, m["v"]["ve"] + AROUND)
        then = lambda g: lambda t, kept: _each(F.array_distinct(_each(kept, lambda m: exons(g, t, m))), lambda x: edges(g, x))
        return self._built(lambda g: self._judged(met(g), window, lambda ratio: ratio > STRONGER, then(g)))


def scored_edges(edges: DataFrame, tracks: DataFrame, key: str, scale: float = 1.0, least_retention: float = -math.inf, least_cryptic: float = -math.inf) -> DataFrame:
    """Edges with their score, the track's sum over [begin + OFFSET, end) times scale; those that can't be are left out.

    tracks: key, kind, track (prefix sums), a row for each kind of edge; an edge without one scores 0. An empty edge, a
    retained intron below least_retention and a cryptic exon below least_cryptic are impossible, as is a score that isn't finite.
    """
    begin = F.least(F.col("begin") + OFFSET, "end")
    summed = edges.join(tracks, [key, "kind"], "left").withColumn("score", F.when(F.col("track").isNull(), 0.0).otherwise(interval_score(F.col("track"), begin, F.col("end")) * scale)).drop("track")
    possible = (F.col("end") > F.col("begin")) & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < math.inf)
    kept = ~((F.col("change") == "intron-retention") & (F.col("score") < least_retention)) & ~((F.col("change") == "cryptic-exon") & (F.col("score") < least_cryptic))
    return summed.filter(possible & kept)


def scored_graphs(edges: DataFrame, sequences: DataFrame, key: str, tracks: dict[str, Column], scale: float = 1.0, least_retention: float = -math.inf, least_cryptic: float = -math.inf) -> DataFrame:
    """scored_edges as one row a transcript: key and edges, an array. tracks: by kind of edge its values by position, made from
    columns of sequences (a row a key)."""
    fields = [c for c in edges.columns if c != key]
    framed = edges.withColumn("from", F.least(F.col("begin") + OFFSET, "end"))
    names = {f"of_{kind}": values for kind, values in tracks.items()}
    rows = sums_by_graph(framed, sequences, key, "from", "end", names)

    def score(e: Column) -> Column:
        own = F.when(~e["kind"].isin(*tracks), F.lit(0.0))
        for kind in tracks:
            own = own.when(e["kind"] == kind, e[f"of_{kind}"] * scale)
        return own

    def possible(e: Column) -> Column:
        ok = (e["end"] > e["begin"]) & e["score"].isNotNull() & ~F.isnan(e["score"]) & (F.abs(e["score"]) < math.inf)
        return ok & ~((e["change"] == "intron-retention") & (e["score"] < least_retention)) & ~((e["change"] == "cryptic-exon") & (e["score"] < least_cryptic))

    scored = F.transform("rows", lambda e: F.struct(*[e[c].alias(c) for c in fields], score(e).alias("score")))
    return rows.select(key, F.filter(scored, possible).alias("edges"))


def _by_graph(edges: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return edges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("edges"))


def _dicts(lists: pa.Array, only: tuple[str, ...] = ()) -> Iterator[list[dict]]:
    """The structs of each list, a column at a time; only: the fields that are wanted, all by default."""
    flat = lists.flatten()
    columns = {f.name: c for f, c in zip(flat.type, flat.flatten(), strict=True) if not only or f.name in only}
    rows = [dict(zip(columns, v, strict=True)) for v in zip(*[c.to_pylist() for c in columns.values()], strict=True)]
    at = 0
    for n in lists.value_lengths().to_pylist():
        yield rows[at : at + n]
        at += n


def _order(edges: list[dict]) -> tuple[list[str], dict[str, list[dict]], dict[str, list[dict]]]:
    """(vertices in topological order, edges out, edges in); what only cycles lead to isn't reached."""
    out: dict[str, list[dict]] = {}
    into: dict[str, list[dict]] = {}
    for e in edges:
        for v in (e["src"], e["dst"]):
            out.setdefault(v, [])
            into.setdefault(v, [])
        out[e["src"]].append(e)
        into[e["dst"]].append(e)
    waiting = {v: len(x) for v, x in into.items()}
    ready = sorted((v for v, n in waiting.items() if not n), reverse=True)
    order = []
    while ready:
        v = ready.pop()
        order.append(v)
        for e in out[v]:
            waiting[e["dst"]] -= 1
            if not waiting[e["dst"]]:
                ready.append(e["dst"])
    return order, out, into


def _connected(edges: list[dict], source: str, sink: str) -> list[dict]:
    """Edges on some path between vertices of the kinds source and sink."""

    def sweep(kind: str, here: str, there: str) -> set[str]:
        ways: dict[str, list[str]] = {}
        for e in edges:
            ways.setdefault(e[here], []).append(e[there])
        seen = {v for e in edges for v in (e["src"], e["dst"]) if v.split("@")[0] == kind}
        todo = list(seen)
        while todo:
            for v in ways.get(todo.pop(), []):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    both = sweep(source, "src", "dst") & sweep(sink, "dst", "src")
    return [e for e in edges if e["src"] in both and e["dst"] in both]


def _pruned_graphs(edges: DataFrame, key: str, source: str, sink: str) -> DataFrame:
    """pruned_edges as one row a transcript: key and edges, an array."""
    ship(edges.sparkSession)
    columns = [c for c in edges.columns if c != key]
    graphs = _by_graph(edges, key, columns)
    kind = pa.list_(pa.struct([(c, _ARROW[t]) for c, t in edges.dtypes if c != key]))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_connected(e, source, sink) for e in _dicts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, kind)], names=[key, "edges"])

    return graphs.mapInArrow(prune, graphs.schema)


def pruned_edges(edges: DataFrame, key: str, source: str = "LT", sink: str = "RT") -> DataFrame:
    """The edges of each transcript that lie on a path from a vertex of kind source to one of kind sink, of any length."""
    return _pruned_graphs(edges, key, source, sink).select(key, F.inline("edges")).select(*edges.columns)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

#: Vertices that a reading frame has to meet in phase 0 (fixed values).
_IN_FRAME = ("ATG", "TAG")


def _phase(phase: int, e: dict) -> int | None:
    """The phase behind an edge; None where a start or stop codon would be out of frame."""
    if e["kind"] == "intergenic":
        return 0
    if e["kind"] == "exon":
        phase = (phase + e["end"] - e["begin"]) % 3
        if e["dst"].split("@")[0] in _IN_FRAME and phase:
            return None
    return phase


def _best(edges: list[dict], n: int, phased: bool) -> list[dict]:
    """The n best paths from vertices without a way in to those without a way on; every (vertex, phase) keeps min(n, QUEUE)."""
    keep = min(n, QUEUE)
    order, out, into = _order(edges)
    held: dict[str, list[list[tuple]]] = {}  # by phase: (-score, path, annotated)
    ends: list[tuple] = []
    for v in order:
        new: list[list[tuple]] = [[], [], []]
        if not into[v]:
            new[0].append((-0.0, v, True))
        for e in into[v]:
            scores = e["scores"] if phased else [e["score"]]
            for phase, paths in enumerate(held.get(e["src"], ())):
                then = _phase(phase, e) if phased else 0
                score = scores[phase if phased and e["kind"] != "intergenic" else 0]
                if then is not None and math.isfinite(score):
                    new[then] += [(s - score, f"{path}>{v}", own and e["annotated"]) for s, path, own in paths]
        held[v] = [heapq.nsmallest(keep, x) for x in new]
        if not out[v]:
            ends += [(*p, phase) for phase, x in enumerate(held[v]) for p in x]
    best = heapq.nsmallest(n, ends)
    return [{"path": path, "score": -s, "rank": k + 1, "annotated": own, "phase": phase} for k, (s, path, own, phase) in enumerate(best)]


def best_paths(edges: DataFrame, key: str, n: int, phased: bool = False) -> DataFrame:
    """key, path, score, rank, annotated (of all its edges) and phase of the n best paths of each transcript's acyclic graph.

    Vertices are taken in topological order, so an edge may pass any number of others and paths may end anywhere. Each vertex
    keeps min(n, QUEUE) partial paths, of which ties go to the smaller text. edges: key, src, dst, score, annotated. phased:
    kind, begin, end and scores (by phase) instead of score; a vertex keeps as many partial paths in each phase. An exon
    advances the phase by its length, an intron carries it on, what is intergenic starts anew in phase 0, and start and stop
    codons, vertices of kind ATG and TAG, end exons in phase 0 alone. Scores that aren't finite make no path.
    """
    columns = ["src", "dst", "kind", "begin", "end", "scores", "annotated"] if phased else ["src", "dst", "score", "annotated"]
    return best_paths_of(_by_graph(edges, key, columns), key, n, phased)


def best_paths_of(graphs: DataFrame, key: str, n: int, phased: bool = False) -> DataFrame:
    """best_paths of graphs that are a row each: key and edges, an array of structs."""
    ship(graphs.sparkSession)
    kind = pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64()), ("rank", pa.int32()), ("annotated", pa.bool_()), ("phase", pa.int32())]))
    head = f"{key} {graphs.schema[key].dataType.simpleString()}"
    wanted = ("src", "dst", "annotated", *(("kind", "begin", "end", "scores") if phased else ("score",)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_best(e, n, phased) for e in _dicts(batch.column(1), wanted)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "paths"])

    out = graphs.mapInArrow(best, f"{head}, paths array<struct<path:string,score:double,rank:int,annotated:boolean,phase:int>>")
    return out.select(key, F.inline("paths"))


def likely_paths(paths: DataFrame, key: str, least: float) -> DataFrame:
    """Paths with their posterior among those of the transcript, at least `least`; mapped: it is the only one left, and annotated."""
    kept = posterior(paths, [key], F.col("score")).filter(F.col("posterior") >= least)
    # beside the posterior, in one pass: a join with their counts would search all paths twice
    alone = F.count("*").over(Window.partitionBy(key)) == 1
    return kept.withColumn("mapped", alone & F.col("annotated"))


def exons_of(path: Column) -> Column:
    """array<struct<begin, end>> of the exons along a path."""
    steps = F.split(path, ">")
    spot = lambda v: F.regexp_extract(v, r"@(\d+)$", 1).cast("int")
    kind = lambda v: F.regexp_extract(v, "^([A-Z]+)@", 1)
    pair = F.zip_with(F.slice(steps, F.lit(1), F.size(steps) - 1), F.slice(steps, F.lit(2), F.size(steps) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    begin = lambda v: spot(v) + F.when(kind(v) == "AG", SITE).otherwise(0)
    return F.transform(F.filter(pair, lambda p: kind(p["a"]).isin("TSS", "AG")), lambda p: F.struct(begin(p["a"]).alias("begin"), spot(p["b"]).alias("end")))


def structures(edges: DataFrame, broken: DataFrame, key: str, most: int) -> DataFrame:
    """(key, exons): the different structures of each transcript that use no broken vertex (key, v), at most `most` (100 or fewer)
    of them in the order of their paths' text. Edges that replace broken sites, skip exons or retain introns are in `edges`."""
    gone = broken.select(key, "v").distinct()
    whole = edges.join(gone.withColumnRenamed("v", "src"), [key, "src"], "left_anti").join(gone.withColumnRenamed("v", "dst"), [key, "dst"], "left_anti")
    lean = whole.select(key, "src", "dst", F.lit(0.0).alias("score"), "annotated")
    paths = best_paths_of(_pruned_graphs(lean, key, "LT", "RT"), key, most)
    return paths.select(key, exons_of(F.col("path")).alias("exons")).distinct()


def translations(paths: DataFrame, sequences: DataFrame, key: str, seq: str, starts: str) -> DataFrame:
    """Each path with start (of its spliced transcript, -1 if none), stop and protein: one translation of a path.

    starts: array<int> of genomic start positions in order of preference; the first that lies in an exon of the path counts.
    stop is where the first stop codon in frame begins, -1 if there is none; the protein then runs to the last whole codon.
    """
    exons = exons_of(F.col("path"))
    rows = paths.withColumn("exons", exons).join(sequences.select(key, F.upper(seq).alias("__seq"), F.col(starts).alias("__starts")), key)
    inside = lambda p, x: F.aggregate(x, F.struct(F.lit(0).alias("at"), F.lit(-1).alias("found")), lambda s, e: F.struct(
        (s["at"] + e["end"] - e["begin"]).alias("at"), F.when((p >= e["begin"]) & (p < e["end"]), s["at"] + p - e["begin"]).otherwise(s["found"]).alias("found")), lambda s: s["found"])
    spliced = rows.withColumn("__rna", sq.splice(F.col("__seq"), F.col("exons")))
    start = F.coalesce(F.get(F.filter(F.transform("__starts", lambda p: inside(p, F.col("exons"))), lambda s: s >= 0), F.lit(0)), F.lit(-1))
    coded = spliced.withColumn("start", start).withColumn("__codons", F.when(F.col("start") >= 0, sq.codons(F.substring("__rna", F.col("start") + 1, F.length("__rna")))))
    first = F.least(*[F.nullif(F.array_position(F.slice("__codons", F.lit(2), F.greatest(F.size("__codons"), F.lit(1))), F.lit(c)), F.lit(0)) for c in sq.STOPS])
    ended = coded.withColumn("__n", first)
    stop = F.when(F.col("__n").isNotNull(), F.col("start") + 3 * F.col("__n").cast("int")).otherwise(F.lit(-1))
    read = F.when(F.col("__n").isNotNull(), F.col("__n").cast("int")).otherwise(F.size("__codons"))
    protein = sq.translate_codons(F.array_join(F.slice("__codons", F.lit(1), F.greatest(read, F.lit(0))), ""))
    return ended.withColumn("stop", stop).withColumn("protein", F.when(F.col("start") >= 0, protein)).drop("__seq", "__starts", "__rna", "__codons", "__n")
