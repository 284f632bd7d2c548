"""Best-fit packing of tokenised documents in bulk-synchronous supersteps.

In a superstep all tasks pack at once, each its own shard of documents. A task range-sorts its documents and the gaps of
its sequences by size. Then it sweeps: all documents of the largest size left look for their successor, the
smallest gap that holds them; of more documents than gaps the lower ranks win, the gaps shrink and re-enter the order, and
the sweep repeats until the size is placed, opening sequences when no gap is left. Lengths are whole numbers up to the
sequence size, so a sweep moves runs of equal documents and gaps, not single ones.

What a shard alone can't fill well is its last few sequences. Between supersteps every shard therefore takes back the
documents of its RELEASED emptiest sequences; they meet those of up to MERGE other shards in the next superstep, until
one shard is left, which keeps all. No histogram, gap or document is gathered on the driver, and a task never holds more
than about SHARD documents, or what MERGE shards release.

A null text counts as empty and still has the closing id. Repeated rows are documents of their own, a null doc_id is
kept, extra columns are left alone.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import LETTER, NUMBER, OTHER, SPACE, ByteBPE
from .common import LOWER, Workspace, freed, prepare, read, shuffle_width, slices, utf8

SEQUENCE = 2048
CLOSING = 0
#: Pieces of a shard, sequences that it gives back, and shards that meet in the next superstep.
SHARD, RELEASED, MERGE = 1 << 15, 32, 16


class WordBPE(ByteBPE):
    """A vocabulary whose words end in a mark: composed, lower-cased texts without white space between pieces."""

    def __init__(self, path: str):
        super().__init__(path)
        import json

        from .bpe_codec import byte_alphabet

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.last_id = np.zeros(256, np.int64)
        for letter, b in byte_alphabet().items():
            self.last_id[b] = model["vocab"][letter + model["end_of_word_suffix"]]

    def _symbols(self, buf, start, lengths):
        out = super()._symbols(buf, start, lengths)
        last = np.cumsum(lengths) - 1
        out[last] = self.last_id[buf[start + lengths - 1]]
        return out

    def encode(self, buf, offs):
        return super().encode(*normalised(buf, offs))

    def pieces(self, buf, offs):
        """Runs of letters, single numbers, runs of anything else but white space, and contractions."""
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, code = self._characters(buf)
        kind = self.classes[np.minimum(code, 0x10FFFF)]
        n = len(at)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, offs[offs < len(buf)])] = True
        first[n] = True
        begins = first.copy()
        begins[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quote = np.flatnonzero((code == 0x27) & begins[:n] & (kind == OTHER))
        quote = quote[~first[quote + 1]]
        follows = code[quote + 1]
        single = quote[np.isin(follows, [ord(c) for c in "stmd"])]
        rest = quote[quote + 2 < n]
        rest = rest[~first[rest + 2]]
        a, b = code[rest + 1], code[rest + 2]
        double = rest[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        for which, size in ((single, 2), (double, 3)):
            begins[which + 1] = False
            begins[which + size] = True
        index = np.flatnonzero(begins[:n])
        start = at[index]
        end = np.concatenate([start[1:], [len(buf)]])
        text = kind[index] != SPACE
        return start[text], end[text]


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """NFC and lower case by character; rows of plain ASCII need only a table."""
    high = np.flatnonzero(buf >= 0x80)
    lower = LOWER[buf]
    if not len(high):
        return lower, offs
    which = np.unique(np.searchsorted(offs, high, "right") - 1)
    raw, parts, sizes, at = buf.tobytes(), [], np.diff(offs).copy(), 0
    for r in which.tolist():
        text = raw[offs[r] : offs[r + 1]].decode("utf-8", "surrogatepass")
        text = unicodedata.normalize("NFC", text)
        # the capital sigma has one lower case here, wherever it stands
        text = text.replace("Σ", "σ").lower()
        new = text.encode("utf-8", "surrogatepass")
        parts += [lower[at : offs[r]], np.frombuffer(new, np.uint8)]
        sizes[r], at = len(new), offs[r + 1]
    parts.append(lower[at:])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


_MODELS: dict[str, WordBPE] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("deal", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    """The pieces of each text, numbered by task and place in it."""
    if path not in _MODELS:
        _MODELS[path] = WordBPE(path)
    bpe, deal = _MODELS[path], TaskContext.get().partitionId() << 36
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        out: list[tuple] = []
        ids_of = batch.column(0).to_pylist()
        for a, b in slices(offs, 4 << 20):
            for k, ids in enumerate(bpe.encode_rows(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), a):
                ids = np.append(ids, CLOSING).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    out.append((ids_of[k], piece, at, len(part), zlib.crc32(part.tobytes()), deal))
                    deal += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, n, first sequence, offset): where the documents of each size class go.

    counts: documents by length, each of 1 .. size.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                first, n = gaps[gap].pop()
                took = min(n, left)
                if took < n:
                    gaps[gap].append((first + took, n - took))
                elif not gaps[gap]:
                    del gaps[gap], order[k]
                runs.append((length, rank, took, first, size - gap))
                give(gap - length, first, took)
                rank, left = rank + took, left - took
                continue
            per = size // length
            full, rest = divmod(left, per)
            for n, each in ((full, per), (1, rest)):
                if n and each:
                    for j in range(each):
                        runs.append((length, rank, n, opened, j * length))
                        rank += n
                    give(size - each * length, opened, n)
                    opened += n
            left = 0
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def packed(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each document: best fit over the range-sorted documents."""
    order = np.argsort(lengths, kind="stable")
    values, first, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    runs = best_fit(dict(zip(values.tolist(), counts.tolist(), strict=True)), size)
    at = np.repeat(first[np.searchsorted(values, runs[:, 0])] + runs[:, 1], runs[:, 2])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(runs[:, 2]) - runs[:, 2], runs[:, 2])
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    where = order[at + nth]
    sequence[where] = np.repeat(runs[:, 3], runs[:, 2]) + nth
    offset[where] = np.repeat(runs[:, 4], runs[:, 2])
    return sequence, offset


OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
STEP = OUT + ", deal long, shard long, open boolean"


def _superstep(batches: Iterator[pa.RecordBatch], size: int, step: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Packs every shard of the task; rows come sorted by shard. open: taken back for the next superstep."""
    held: list[pa.RecordBatch] = []

    def settle() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        length = t["length"].to_numpy()
        sequence, offset = packed(length, size)
        used = np.bincount(sequence, weights=length).astype(np.int64)
        back = np.zeros(len(used), bool)
        if not last:
            some = np.argsort(used, kind="stable")[:RELEASED]
            back[some[used[some] < size]] = True
        shard = int(t["shard"][0].as_py())
        named = (step << 58) + (shard << 34) + sequence
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*(t[n].combine_chunks() for n in names), pa.array(named), pa.array(offset), *(t[n].combine_chunks() for n in ("deal", "shard")), pa.array(back[sequence])], names=[*names, "sequence_id", "offset", "deal", "shard", "open"])

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                if held and held[0].column("shard")[0].as_py() != shard[a]:
                    yield settle()
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield settle()


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    ws = Workspace(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    todo = ws.put(narrow.mapInArrow(freed(lambda b: _cut(b, path, size)), PIECES), "pieces")
    shards = max(1, -(-todo.count() // shard))
    todo = todo.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
    placed, step = None, 0
    while True:
        last = shards == 1
        rows = todo.repartition(min(shards, shuffle_width(spark)), "shard").sortWithinPartitions("shard", "deal")
        done = ws.put(rows.mapInArrow(freed(lambda b, n=step, end=last: _superstep(b, size, n, end)), STEP), "superstep")
        kept = done.filter("not open").drop("deal", "shard", "open")
        placed = kept if placed is None else placed.unionByName(kept)
        if last:
            return placed
        shards, step = -(-shards // MERGE), step + 1
        todo = done.filter("open").withColumn("shard", F.pmod("shard", F.lit(shards)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
