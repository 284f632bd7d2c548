"""Joins and sweeps over half-open intervals. A range predicate alone would compare all pairs, so sides meet in bins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dealing import PART_ROWS, parts_for
from ..functions.shipping import ship


def bins(begin: Column, end: Column, width: float) -> Column:
    """The bins that [begin, end) touches."""
    first = F.floor(begin / width)
    return F.sequence(first, F.greatest(first, F.ceil(end / width) - 1))


#: How many bins of one level a region may touch; a wider one uses bins this many times as wide, and so on.
BINS_A_REGION = 16
#: Regions of one level up to which they are sent to the points, however many share a bin, instead of both to their bins.
SENT_REGIONS = 1 << 14


def point_in_region(points: DataFrame, regions: DataFrame, point: str, begin: str, end: str, width: float, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points joined with the regions that hold them: an equi-join on bins, then the range. how: inner, left_semi or left_anti.

    A region of any width touches at most BINS_A_REGION + 1 bins of its level, so an open-ended one costs no more than others.
    Few regions have few bins, which would gather all points in as few tasks: they go to the points, which stay where they are.
    """
    keys = on or []
    wide = F.greatest((F.col(end) - F.col(begin)) / (width * BINS_A_REGION), F.lit(1.0))
    levelled = regions.withColumn("__level", F.ceil(F.log(float(BINS_A_REGION), wide)).cast("int"))
    levels = sorted(tuple(r) for r in levelled.groupBy("__level").count().collect() if r[0] is not None)
    out = None if how == "inner" else points
    chosen = points.limit(0)
    for level, count in levels:
        size = width * float(BINS_A_REGION) ** level
        spread = levelled.filter(F.col("__level") == level).withColumn("__bin", F.explode(bins(F.col(begin), F.col(end), size)))
        located = (points if how == "inner" else out).withColumn("__bin", F.floor(F.col(point) / size))
        p, r = located.alias("p"), (F.broadcast(spread) if count <= SENT_REGIONS else spread).alias("r")
        cond = (F.col("p.__bin") == F.col("r.__bin")) & (F.col(f"p.{point}") >= F.col(f"r.{begin}")) & (F.col(f"p.{point}") < F.col(f"r.{end}"))
        for k in keys:
            cond &= F.col(f"p.{k}") == F.col(f"r.{k}")
        cols = [F.col(f"p.{c}") for c in points.columns]
        if how == "inner":
            found = p.join(r, cond).select(*cols, *[F.col(f"r.{c}") for c in regions.columns if c not in keys])
            out = found if out is None else out.unionByName(found)
        else:
            # what a level has decided leaves, so that no point is found twice
            chosen = chosen.unionByName(p.join(r, cond, "left_semi").select(*cols))
            out = p.join(r, cond, "left_anti").select(*cols)
    if how == "inner" and out is None:
        return points.join(regions, F.lit(False)) if not keys else points.join(regions, keys).limit(0)
    return chosen if how == "left_semi" else out


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], ab: tuple[str, str], bb: tuple[str, str], width: float, contains: bool = False) -> DataFrame:
    """Pairs of intervals with equal `on` that overlap (or of which a contains b); each pair once, in one bin."""
    left = a.withColumn("__bin", F.explode(bins(F.col(ab[0]), F.col(ab[1]), width))).alias("a")
    right = b.withColumn("__bin", F.explode(bins(F.col(bb[0]), F.col(bb[1]), width))).alias("b")
    a0, a1, b0, b1 = F.col(f"a.{ab[0]}"), F.col(f"a.{ab[1]}"), F.col(f"b.{bb[0]}"), F.col(f"b.{bb[1]}")
    cond = (F.col("a.__bin") == F.col("b.__bin")) & (F.col("a.__bin") == F.floor(F.greatest(a0, b0) / width))
    cond &= ((a0 <= b0) & (b1 <= a1)) if contains else ((a0 < b1) & (b0 < a1))
    for k in on:
        cond &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return left.join(right, cond).select(*[F.col(f"a.{c}") for c in a.columns], *[F.col(f"b.{c}") for c in b.columns if c not in on])


def band_join(df: DataFrame, on: list[str], pos: str, most: float, ident: str) -> DataFrame:
    """Pairs (later, earlier) with equal `on` whose positions differ by at most `most`, ties by ident."""
    a = df.withColumn("__bin", F.floor(F.col(pos) / most)).alias("a")
    near = F.explode(F.array(F.floor(F.col(pos) / most), F.floor(F.col(pos) / most) + 1))
    b = df.withColumn("__bin", near).alias("b")
    apart = F.col(f"a.{pos}") - F.col(f"b.{pos}")
    cond = (F.col("a.__bin") == F.col("b.__bin")) & (apart <= most) & ((apart > 0) | ((apart == 0) & (F.col(f"a.{ident}") > F.col(f"b.{ident}"))))
    for k in on:
        cond &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, cond).select(*[F.col(f"a.{k}") for k in on], F.col(f"a.{ident}").alias("later"), F.col(f"b.{ident}").alias("earlier"), apart.alias("apart"))


def step_join(df: DataFrame, on: list[str], value: str, least: int, most: int, ident: str) -> DataFrame:
    """Pairs (earlier, later) with equal `on` whose whole-numbered values differ by least..most, an equi-join on the earlier value.

    Every row meets its own pairs alone, none are thrown away. All of a value's rows share their partners, which come in the
    same order each time, so the pairs, whose number may grow with the square of the rows, compress well where they are
    written. Parts follow the rows, not their few bytes.
    """
    parts = parts_for(df, PART_ROWS // 8)
    a = df.select(F.col(ident).alias("earlier"), *on, F.col(value).alias("__v"))
    b = df.select(F.col(ident).alias("later"), *on, F.explode(F.array(*[F.col(value) - k for k in range(least, most + 1)])).alias("__v"))
    keys = [*on, "__v"]
    return a.repartition(parts, *keys).join(b.repartition(parts, *keys), keys).select("earlier", "later")


def with_island(df: DataFrame, by: list[str], begin: str, end: str, tie: str) -> DataFrame:
    """Numbers the maximal groups of overlapping or touching intervals, from 1 in order of begin."""
    order = Window.partitionBy(*by).orderBy(begin, end, tie)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(begin) > before), 1).otherwise(0)
    return df.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def islands(df: DataFrame, by: list[str], begin: str, end: str, tie: str) -> DataFrame:
    """The coalesced intervals with their number of members."""
    return with_island(df, by, begin, end, tie).groupBy(*by, "island").agg(F.min(begin).alias("begin"), F.max(end).alias("end"), F.count("*").alias("members"))


def depth(df: DataFrame, by: list[str], begin: str, end: str, weight: Column | None = None) -> DataFrame:
    """Coverage by sweep line: the depth from each position where it changes; ends count before begins."""
    w = F.lit(1) if weight is None else weight
    steps = df.select(*by, F.col(begin).alias("pos"), w.alias("step")).unionAll(df.select(*by, F.col(end).alias("pos"), (-w).alias("step")))
    steps = steps.groupBy(*by, "pos").agg(F.sum("step").alias("step"))
    run = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*by, "pos", F.sum("step").over(run).alias("depth"))


def closure_winner(df: DataFrame, by: list[str], begin: str, end: str, tie: str) -> DataFrame:
    """Of each transitive closure of overlapping intervals the longest, the first on ties, and the closure's size."""
    grouped = with_island(df, by, begin, end, tie)
    # strictly the longest; a struct maximum combines before the shuffle
    best = F.max(F.struct((F.col(end) - F.col(begin)).alias("length"), (-F.col(begin)).alias("b"), (-F.col(tie)).alias("t")))
    return grouped.groupBy(*by, "island").agg(best.alias("w"), F.count("*").alias("members")).select(*by, "island", (-F.col("w.t")).alias("winner"), F.col("w.length").alias("length"), "members")


def fixed_bins(df: DataFrame, length: str, width: int) -> DataFrame:
    """[begin, end) bins of `width` over 0 .. length."""
    begin = F.explode(F.sequence(F.lit(0), F.greatest(F.col(length) - 1, F.lit(0)), F.lit(width)))
    return df.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + width, F.col(length)))


def apply_edits(df: DataFrame, by: list[str], pos: str, ref: str, alt: str) -> DataFrame:
    """Adds alt_pos: where each edit starts in the edited sequence, from the running change of length before it."""
    order = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    delta = F.coalesce(F.sum(F.length(ref) - F.length(alt)).over(order), F.lit(0))
    return df.withColumn("delta", delta).withColumn("alt_pos", F.col(pos) - F.col("delta"))


#: Pieces of a block, the stretch of a sequence that one task cuts by itself.
BLOCK_PIECES = 256


def segments(masked: DataFrame, lengths: DataFrame, on: str, begin: str, end: str, length: str, size: int) -> DataFrame:
    """(on, begin, end): each sequence cut into pieces of `size`, a cut that would fall on a masked base moved on to the next
    free one, so that a piece's end depends on the one before. The last piece ends with the sequence.

    masked: half-open intervals, in any order and overlapping as they may; sequences without any are cut evenly. Sequences fall
    into blocks of BLOCK_PIECES pieces. Each block first tells, for every place at which a cut may be due in it, the place due
    behind it; most places soon meet in the same cuts. Then only these tables are followed along a sequence, and with its
    first place known each block is cut by itself.
    """
    ship(masked.sparkSession)
    width, parts = size * BLOCK_PIECES, parts_for(masked)
    key = f"{on} {lengths.schema[on].dataType.simpleString()}"
    b, e = F.greatest(F.col(begin).cast("long"), F.lit(0)), F.col(end).cast("long")
    whole = masked.select(on, b.alias("b"), e.alias("e")).filter("e > b").join(F.broadcast(lengths.select(on)) if lengths.count() <= SENT_REGIONS else lengths.select(on), on, "left_semi")
    split = whole.withColumn("block", F.explode(bins(F.col("b"), F.col("e"), width)))
    none = F.lit(None).cast("long")
    marks = split.select(on, "block", F.greatest("b", F.col("block") * width).alias("b"), F.least("e", (F.col("block") + 1) * width).alias("e"), none.alias("due"), none.alias("n"))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, ib, ie, _ in _blocks(batches):
            lo, due, last = _ways(ib, ie, block * width, (block + 1) * width, size)
            yield _batch([on, "block", "n", "lo", "due", "last"], [name, pa.array([block]), pa.nulls(1, pa.int64()), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (lo, due, last)]])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, at, due, k, out = None, 0, 0, 0, 0, []

        def passed(upto: int) -> Iterator[pa.RecordBatch]:
            """Blocks before `upto`, which have no masked base."""
            nonlocal at, due, k
            while k < min(upto, -(-n // width)):
                out.append((k, at, due, n))
                steps = max(0, -((due - (k + 1) * width) // size))
                at, due, k = due + (steps - 1) * size if steps else at, due + steps * size, k + 1
                if len(out) >= 10000:
                    yield told()

        def told() -> pa.RecordBatch:
            cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
            batch = _batch([on, "block", "b", "due", "n"], [pa.concat_arrays([name] * len(out)), *cols])
            out.clear()
            return batch

        for batch in batches:
            for row in range(batch.num_rows):
                block, new = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                if new is not None:
                    yield from passed(1 << 62)
                    if out:
                        yield told()
                    name, n, at, due, k = batch.column(0).slice(row, 1), new, 0, size, 0
                    continue
                yield from passed(block)
                if block * width < n:
                    out.append((k, at, due, n))
                    lo, then, last = (batch.column(c)[row].values.to_numpy() for c in (3, 4, 5))
                    way = lo.searchsorted(due - block * width, "right") - 1
                    at, due, k = int(last[way]) if last[way] >= 0 else at, int(then[way]), k + 1
        yield from passed(1 << 62)
        if out:
            yield told()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, ib, ie, first in _blocks(batches):
            if first is None:
                continue
            (at, due, n), stop, out = first, (block + 1) * width, []
            while due < min(stop, n):
                k = int(ib.searchsorted(due, "right")) - 1
                free = int(ie[k]) if k >= 0 and ie[k] > due else due
                if free >= min(stop, n):
                    break
                out.append((at, free))
                at, due = free, free + size
            if stop >= n:
                out.append((at, n))
            if out:
                yield _batch([on, "begin", "end"], [pa.concat_arrays([name] * len(out)), *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]])

    tables = marks.repartition(parts, on, "block").sortWithinPartitions(on, "block", "b", "e").mapInArrow(ways, f"{key}, block long, n long, lo array<long>, due array<long>, last array<long>")
    empty = F.lit(None).cast("array<long>")
    heads = lengths.select(on, F.lit(-1).cast("long").alias("block"), F.col(length).cast("long").alias("n"), empty.alias("lo"), empty.alias("due"), empty.alias("last"))
    entries = heads.unionByName(tables).repartition(on).sortWithinPartitions(on, "block").mapInArrow(follow, f"{key}, block long, b long, due long, n long")
    # an entry comes before its block's marks: its e is null
    both = entries.withColumn("e", none).unionByName(marks)
    ordered = both.repartition(parts, on, "block").sortWithinPartitions(on, "block", F.col("e").isNotNull(), "b", "e")
    return ordered.mapInArrow(cut, f"{key}, begin long, end long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(name as an array of one, block, begins and ends of its maximal masked stretches, its entry or None), of rows in order."""
    import numpy as np
    import pyarrow.compute as pc

    now, name, first, held = None, None, None, []

    def merged() -> tuple:
        b, e = (np.concatenate([x[c] for x in held]) if held else np.zeros(0, np.int64) for c in (0, 1))
        if not len(b):
            return b, e
        reach = np.maximum.accumulate(e)
        new = np.concatenate([[True], b[1:] > reach[:-1]])
        return b[new], reach[np.concatenate([np.flatnonzero(new)[1:], [len(b)]]) - 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.select([0, *(batch.schema.get_field_index(c) for c in ("block", "b", "e", "due", "n"))])
        block = batch.column(1).to_numpy()
        other = pc.fill_null(pc.not_equal(batch.column(0).slice(1), batch.column(0).slice(0, batch.num_rows - 1)), True).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | other) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            here = (batch.column(0)[lo].as_py(), int(block[lo]))
            if here != now:
                if now is not None:
                    yield (name, now[1], *merged(), first)
                now, name, first, held = here, batch.column(0).slice(lo, 1), None, []
            if batch.column(3)[lo].as_py() is None:
                first = tuple(batch.column(c)[lo].as_py() for c in (2, 4, 5))
                lo += 1
            if hi > lo:
                held.append(tuple(batch.column(c).slice(lo, hi - lo).to_numpy() for c in (2, 3)))
                if len(held) > 256:  # copies and overlaps don't pile up
                    held = [merged()]
    if now is not None:
        yield (name, now[1], *merged(), first)


def _ways(ib, ie, start: int, stop: int, size: int) -> tuple:
    """(lo, due, last): from each offset lo up to the next one, a cut due there leads to the same place due at or behind stop,
    and to the same last cut in the block, -1 for none."""
    import numpy as np

    lo = np.arange(size + 1)
    due, last = start + lo, np.full(size + 1, -1)
    while True:
        open_ = np.flatnonzero(due < stop)
        if not len(open_):
            return lo, due, last
        k = np.searchsorted(ib, due[open_], "right") - 1
        free = np.where(k >= 0, np.maximum(ie[np.maximum(k, 0)], due[open_]), due[open_])
        inside = free < stop
        last[open_[inside]] = free[inside]
        due[open_] = np.where(inside, free + size, stop)
        keep = np.concatenate([[True], (due[1:] != due[:-1]) | (last[1:] != last[:-1])])
        lo, due, last = lo[keep], due[keep], last[keep]


def _batch(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)
