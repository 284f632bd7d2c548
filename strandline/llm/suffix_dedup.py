"""Suffix-array dedup: removes every byte covered by a string of `size` bytes that also starts anywhere else.

1. A window is a string of `size` bytes. Its anchor is the GRAM-byte string inside with the least hash, the leftmost of equal
   ones. Each text is cut into runs of windows with one anchor, keyed by the hash of the anchor's bytes. Equal windows have
   equal anchors at equal places, so what repeats meets at one key; a key with a single run is settled.
2. Runs that are equal as a whole are one class, counted before anything is gathered: however many copies a text has, a key
   sorts one of them, and a class of two or more repeats whole.
3. The classes of each key are sorted: the grouping construction of suffix_array.py orders the suffixes of all of them,
   and neighbours in that order that agree in `size` bytes repeat. Nothing is looked up by a window's hash.
4. A key of more than KEY_BYTES, as beside a passage that very many documents share, is too much for one suffix array. Its
   runs split into overlapping pieces: the windows of each of WIDTHS distances to the anchor, keyed by the bytes that all
   of them have in common. Pieces are runs again: equal ones are counted as one class, the others sorted, and pieces of
   keys that are still too large split by the next width. At the last width, 1, a piece is one window, equal ones
   are one class, and nothing is left to split.

Equal runs are told by 64 bits of hash within one key of 64 bits. Texts are UTF-8 bytes; a null text is empty; matches
never cross rows; a repeated row is another place; rows with equal doc_id (or none) are told apart by their texts; extra
columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, freed, prepare, read, rolling, shuffle_width, slices, tidy, utf8
from .suffix_array import suffix_array, suffix_arrays

SIZE = 200
GRAM = 64
#: Bytes that one suffix array may sort; distances to the anchor that pieces of larger keys hold, round by round.
KEY_BYTES = 1 << 15
WIDTHS = (32, 8, 1)
#: Bytes of keys that a task sorts together, and the least number of keys worth sorting in step.
TOGETHER, IN_STEP = 4 << 20, 32

RUN = "key long, class long, doc_id long, row_key long, start int, n int, anchor int"
_RUN = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int32())])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: running minima from both sides of blocks of w."""
    n = len(x)
    size = -(-n // w) * w
    padded = np.full(size, np.uint64(2**64 - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(buf: np.ndarray, offs: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in buf, windows, anchor in buf, key) of each run of windows with one anchor."""
    n, w = len(buf), size - gram + 1
    counts = np.maximum(np.diff(offs) - size + 1, 0)
    if not counts.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    hashes = rolling(buf, gram)
    # the upper half of a hash decides, then the place: equal windows decide alike, whatever surrounds them
    anchor = (sliding_min(hashes & np.uint64(0xFFFFFFFF << 32) | np.arange(len(hashes), dtype=np.uint64), w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    full = counts > 0
    first, last = offs[:-1][full], (offs[:-1] + counts)[full]
    inside = np.zeros(n + 1, np.int8)
    inside[first] += 1
    inside[last] -= 1
    inside = np.cumsum(inside[: len(anchor)], dtype=np.int8) > 0
    begins = inside.copy()
    begins[1:] &= anchor[1:] != anchor[:-1]
    begins[first] = True
    start = np.flatnonzero(begins)
    row = np.searchsorted(offs, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(anchor)), (offs[:-1] + counts)[row])
    return row, start, stop - start, anchor[start], hashes[anchor[start]]


def _digest(parts: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = utf8(batch.column(2))
        for a, b in slices(offs):
            part = np.ascontiguousarray(buf[offs[a] : offs[b]])
            local = offs[a : b + 1] - offs[a]
            row, start, n, anchor, key = runs_of(part, local, size, gram)
            view = memoryview(part)
            same = _digest([view[i:j] for i, j in zip(start.tolist(), (start + n + size - 1).tolist(), strict=True)])
            take = pa.array(row + a)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(same), batch.column(0).take(take), batch.column(1).take(take), pa.array((start - local[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((anchor - start).astype(np.int32))], schema=_RUN)


_TEXTS = pa.schema([*_RUN, ("copies", pa.int64()), ("bytes", pa.binary())])
TEXTS = RUN + ", copies long, bytes binary"


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each class asked for of a row."""
    for batch in batches:
        out, held = [], 0
        for doc_id, row_key, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for r in asked:
                out.append((r["key"], r["class"], doc_id, row_key, r["start"], r["n"], r["anchor"], r["copies"], raw[r["start"] : r["start"] + r["n"] + size - 1]))
                held += r["n"] + size
                if held > 4 << 20:
                    yield _batch(out, _TEXTS)
                    out, held = [], 0
        if out:
            yield _batch(out, _TEXTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[pa.RecordBatch]:
    """Each run's windows by distance to the anchor, `width` distances a piece, keyed by what all such windows hold."""
    names = [f.name for f in _TEXTS]
    for batch in batches:
        out, held = [], 0
        for key, _, doc_id, row_key, start, n, anchor, copies, raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            for j in range((anchor - n + 1) // width, anchor // width + 1):
                # windows at distances j * width .. (j + 1) * width - 1, those farther first
                a, b = max(0, anchor - (j + 1) * width + 1), min(n - 1, anchor - j * width)
                core = raw[anchor - j * width : anchor - (j + 1) * width + 1 + size]
                piece = raw[a : b + size]
                out.append((xxhash.xxh3_64_intdigest(core, seed=(key * 31 + j * 7 + width) & 0xFFFFFFFFFFFFFFFF), xxhash.xxh3_64_intdigest(piece, seed=a - anchor & 0xFFFF), doc_id, row_key, start + a, b - a + 1, anchor - a, copies, piece))
                held += len(piece) + 64
            if held > 4 << 20:
                yield _signed(out)
                out, held = [], 0
        if out:
            yield _signed(out)


def _signed(rows: list[tuple]) -> pa.RecordBatch:
    wrap = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return _batch([(wrap(r[0]), wrap(r[1]), *r[2:]) for r in rows], _TEXTS)


SPANS = "doc_id long, row_key long, start int, n int"
_SPANS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def repeated_windows(groups: list[list[tuple[bytes, int, int]]], size: int) -> list[np.ndarray]:
    """For each text (bytes, windows, copies) of all groups, in order, the window starts that occur again in its group: in
    another text, in its own, or in a copy of it. Each group's texts, each ended by 1, are one string, ended by 0."""
    totals = np.array([sum(len(t) + 1 for t, _, _ in g) + 1 for g in groups])
    rank = np.argsort(-totals, kind="stable")
    bases = np.empty(len(groups), np.int64)
    bases[rank] = np.cumsum(totals[rank]) - totals[rank]
    joined = np.zeros(int(totals.sum()) + size, np.int16)
    owner, copied = np.full(len(joined), -1, np.int32), []
    starts = []
    for g, base in zip(groups, bases.tolist(), strict=True):
        at = base
        for t, n, copies in g:
            joined[at : at + len(t)] = np.frombuffer(t, np.uint8)
            joined[at : at + len(t)] += 2
            joined[at + len(t)] = 1
            owner[at : at + n] = len(copied)
            starts.append((at, n))
            copied.append(copies > 1)
            at += len(t) + 1
    total = len(joined) - size
    if len(groups) >= IN_STEP:
        order = suffix_arrays(joined[:total], totals[rank])
    else:
        order = np.concatenate([np.array(suffix_array(joined[b : b + t].tolist()), np.int64) + b for b, t in zip(bases[rank].tolist(), totals[rank].tolist(), strict=True)])
    order = order[owner[order] >= 0]
    flags = np.array(copied, bool)[owner[order]]
    # neighbours are compared eight bytes at a time; a text's ends differ from all bytes, a group's neighbours belong to it
    eight = np.lib.stride_tricks.sliding_window_view(np.where(joined >= 2, joined - 2, 0).astype(np.uint8), 8).copy().view("<u8").ravel()
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    left = np.flatnonzero(group_of[owner[order[:-1]]] == group_of[owner[order[1:]]])
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        left = left[eight[order[left] + k] == eight[order[left + 1] + k]]
    flags[left] = True
    flags[left + 1] = True
    found = np.zeros(total, bool)
    found[order[flags]] = True
    return [np.flatnonzero(found[a : a + n]) for a, n in starts]


def _sorted_keys(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Spans of the single classes of each key; rows come sorted by key and class."""
    groups: list[list[tuple]] = []
    held = 0
    names = ("doc_id", "row_key", "key", "class", "start", "n", "copies", "bytes")

    def settle() -> Iterator[pa.RecordBatch]:
        groups.sort(key=lambda g: -sum(len(r[7]) for r in g))
        out: list[tuple] = []
        at = 0
        while at < len(groups):
            # keys of about the same size are sorted in step
            least = 0.7 * sum(len(r[7]) for r in groups[at])
            to = at + 1
            while to < len(groups) and sum(len(r[7]) for r in groups[to]) >= least:
                to += 1
            part = groups[at:to]
            at = to
            found = repeated_windows([[(r[7], r[5], r[6]) for r in g] for g in part], size)
            for r, starts in zip((r for g in part for r in g), found, strict=True):
                if r[6] == 1 and len(starts):
                    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                        out.append((r[0], r[1], r[4] + int(run[0]), len(run)))
        if out:
            yield _batch(out, _SPANS)

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if not groups or groups[-1][0][2] != row[2]:
                if held > TOGETHER:
                    yield from settle()
                    groups, held = [], 0
                groups.append([row])
            elif groups[-1][-1][3] == row[3]:
                continue  # the class of a repeated row
            else:
                groups[-1].append(row)
            held += len(row[7])
    yield from settle()


def _cover(length: int, starts, counts, size: int) -> np.ndarray:
    """Which of a text's bytes lie in a window of the runs (starts, counts)."""
    edge = np.zeros(length + 1, np.int32)
    if starts:
        s = np.asarray(starts, np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + np.asarray(counts, np.int64) + size - 1, -1)
    return np.cumsum(edge[:-1]) > 0


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, *spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "starts", "counts")), strict=True):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            gone = _cover(len(raw), *spans, size)
            n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((doc_id, len(raw), int(gone.sum()), n_spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        yield _batch(out, _OUT)


def _kept(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows with what is left of their texts; what a cut leaves of a character goes too."""
    for batch in batches:
        texts, points = [], []
        for text, *spans in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "counts")), strict=True):
            if spans[0]:
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                text = raw[~_cover(len(raw), *spans, size)].tobytes().decode("utf-8", "ignore")
            texts.append(text)
            points.append(len(text))
        row = batch.column("row")
        columns = []
        for field, own in zip(row.type, row.flatten(), strict=True):
            columns.append(pa.array(texts, own.type) if field.name == "text" else pa.array(points, own.type) if field.name == "n_chars" else own)
        yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in row.type])


def _with_spans(docs: DataFrame, size: int, gram: int, key_bytes: int) -> DataFrame:
    """id, text and row (all columns of docs), with the starts and lengths of runs of repeated windows."""
    spark = docs.sparkSession
    prepare(spark)
    ws = Workspace(spark)
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("id"), F.xxhash64(doc_id, text).alias("mark"), text.alias("text"), F.struct("*").alias("row"))
    place = F.min(F.struct("row_key", "start", "doc_id", "anchor")).alias("first")
    one_class = ["key", "class", "n"]
    keys = lambda classes: classes.groupBy("key").agg(F.count("*").alias("c"), F.min("copies").alias("least"), F.sum(F.col("n") + size - 1).alias("held")).filter("least = 1 and c > 1")

    found = ws.put(keyed.select("id", "mark", "text").mapInArrow(freed(lambda b: _runs(b, size, gram)), RUN), "runs")
    often = found.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = ws.put(found.join(often, "key"), "members")
    ws.drop(found)
    tidy(spark)
    classes = ws.put(members.groupBy(*one_class).agg(F.count("*").alias("copies"), place).select(*one_class, "copies", "first.*"), "classes")
    whole = members.join(classes.filter("copies > 1").select(*one_class), one_class).select("doc_id", "row_key", "start", "n")
    spans = ws.put(whole, "spans")
    ws.drop(members)
    wanted = classes.join(keys(classes).select("key"), "key").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("key", "class", "start", "n", "anchor", "copies")).alias("asked"))
    same_row = (F.col("mark") == F.col("row_key")) & F.col("id").eqNullSafe(F.col("doc_id"))
    texts = keyed.select("id", "mark", "text").join(wanted, same_row).select("doc_id", "row_key", "text", "asked")
    texts = ws.put(texts.mapInArrow(freed(lambda b: _texts(b, size)), TEXTS), "texts")
    ws.drop(classes)
    tidy(spark)
    for width in (*WIDTHS, 0):
        held = texts.groupBy("key").agg((F.sum(F.length("bytes")) > key_bytes).alias("large"))
        dealt = texts.join(held, "key")
        small = dealt.filter("not large" if width else "true").drop("large").repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "class")
        spans = spans.unionByName(ws.put(small.mapInArrow(freed(lambda b: _sorted_keys(b, size)), SPANS), "spans"))
        large = dealt.filter("large").drop("large")
        if not width or large.isEmpty():
            break
        pieces = ws.put(large.dropDuplicates(["key", "class"]).mapInArrow(freed(lambda b, w=width: _pieces(b, size, w)), TEXTS), "pieces")
        # a class's copies count for all its members; only members that are single so far can still gain by it
        classes = pieces.groupBy(*one_class).agg(F.sum("copies").alias("total"), F.min(F.struct("row_key", "start", "doc_id")).alias("first"))
        classes = ws.put(classes, "classes")
        whole = pieces.filter("copies = 1").join(classes.filter("total > 1").select(*one_class), one_class).select("doc_id", "row_key", "start", "n")
        spans = spans.unionByName(ws.put(whole, "spans"))
        open_keys = keys(classes.withColumnRenamed("total", "copies")).select("key")
        chosen = classes.join(open_keys, "key").select(*one_class, "total", F.col("first.row_key").alias("r"), F.col("first.start").alias("s"), F.col("first.doc_id").alias("d"))
        matches = (pieces["row_key"] == chosen["r"]) & (pieces["start"] == chosen["s"]) & pieces["doc_id"].eqNullSafe(chosen["d"])
        for c in one_class:
            matches &= pieces[c] == chosen[c]
        texts = ws.put(pieces.join(chosen, matches).select(*[pieces[c] for c in ("key", "class", "doc_id", "row_key", "start", "n", "anchor")], chosen["total"].alias("copies"), pieces["bytes"]), "texts")
        tidy(spark)
    by_row = spans.groupBy("doc_id", "row_key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    return keyed.join(by_row, same_row, "left").drop("doc_id", "row_key", "mark")


def suffix_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text)."""
    found = _with_spans(docs.select("doc_id", "text"), size, gram, key_bytes)
    return found.select("id", "text", "starts", "counts").mapInArrow(freed(lambda b: _digests(b, size)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, key_bytes: int = KEY_BYTES) -> DataFrame:
    """docs with what is left of each text (n_chars follows); all rows and columns stay."""
    found = _with_spans(docs, size, gram, key_bytes)
    return found.select("row", "text", "starts", "counts").mapInArrow(freed(lambda b: _kept(b, size)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))
