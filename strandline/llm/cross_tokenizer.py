"""Alignment of two tokenizers' tokens by the bytes they share, and corpus-wide counts of the id pairs that meet.

A text is a run of units: every space after a character that isn't white space opens one, and neither tokenizer has a
token across such a place (byte-level pieces hold a space only in front, and no piece of the second vocabulary holds its
space mark after another character; a vocabulary that does is refused). So different units are encoded once, by the
libraries, and a document is the sum of its units. Units align in one flat step: the cumulated byte lengths of the tokens
are their ends, intersect1d gives the places where both end, searchsorted the group of every token, and the ids of a
group's one side are repeated for those of the other. Different ids of a side are taken once, with how often they come, so
that a long group costs its different ids and not its links.

A task writes its documents in blocks of about BLOCK_BYTES, and for each block the id pairs it holds and in how many of its
documents: that combines before the shuffle. Counts are summed per pair and salt, then per pair; every block fetches the
totals of its own pairs, one row for each block and pair, and is finished in one co-grouped step. Nothing is broadcast.

Null and empty texts, and texts whose tokens don't give back space + text on both sides (U+2581 in the text, which the
second library takes for a space), have no tokens: zeros, and '' for the digest. Every row is a document of its own, also
where doc_id repeats or is null. Extra columns are left alone. A text is held in memory as a whole, with one number for each
unit of it; it is encoded in steps of about CHUNK_BYTES, or of one unit where that is longer.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import byte_alphabet
from .common import CHUNK_BYTES, Workspace, distinct, expand, freed, prepare, read, release, utf8

#: Text bytes whose documents share one row for each id pair.
BLOCK_BYTES = 4 << 20
#: Units a task remembers from one block to the next.
UNITS = 1 << 18
#: Parts in which a pair's counts are summed first.
SALTS = 16
#: The second vocabulary's mark of a space (fixed value).
SPACE_MARK = "▁"


class Tokenizers:
    """Both libraries' encoders with the bytes of every id."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        back = byte_alphabet()
        with open(first, encoding="utf-8") as f:
            own = json.load(f)["model"]["vocab"]
        size = 1 + max(own.values())
        self.a_bytes = [b""] * size
        for token, i in own.items():
            if all(c in back for c in token):
                self.a_bytes[i] = bytes(back[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError(f"{second} has pieces that hold a space mark after another character")
        self.b_bytes = [
            b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.space = [self.b.piece_to_id(SPACE_MARK)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space, which the second library adds itself."""
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [ids if t != " " else self.space for t, ids in zip(texts, b, strict=True)]


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(first: str, second: str) -> Tokenizers:
    if (first, second) not in _LOADED:
        _LOADED[first, second] = Tokenizers(first, second)
    return _LOADED[first, second]


def align(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where both sides end, group of each token of the first side, of the second), from ascending token ends."""
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    return cuts, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)


def _ids_of_groups(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of the different ids of each group, by group."""
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def linked(a_group: np.ndarray, a_ids: np.ndarray, b_group: np.ndarray, b_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first id << 32 | second id, links) of every different id pair of each of n groups."""
    ag, ai, at = _ids_of_groups(a_group, a_ids)
    bg, bi, bt = _ids_of_groups(b_group, b_ids)
    many = np.bincount(bg, minlength=n)
    first = np.cumsum(many) - many
    left = np.repeat(np.arange(len(ag)), many[ag])
    right = expand(first[ag], many[ag])
    return ag[left], ai[left] << 32 | bi[right], at[left] * bt[right]


def summed(major: np.ndarray, minor: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n by (major, minor), sorted by both."""
    order = np.lexsort((minor, major))
    major, minor, n = major[order], minor[order], n[order]
    new = np.ones(len(major), bool)
    new[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
    at = np.flatnonzero(new)
    return major[at], minor[at], np.add.reduceat(n, at) if len(at) else n


class Units:
    """What is known of every unit seen: token, group and link counts, its groups as text, its id pairs and their links."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.slot, self.text = tokenizers, {}, []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of either side, groups, links
        self.valid = np.zeros(0, bool)
        self.pairs = np.zeros(1, np.int64)  # where each unit's id pairs begin
        self.code = self.times = np.zeros(0, np.int64)

    def slots(self, strings: list[bytes]) -> np.ndarray:
        new = [s for s in strings if s not in self.slot]
        if new:
            self._learn(new)
        return np.fromiter((self.slot[s] for s in strings), np.int32, len(strings))

    def _learn(self, new: list[bytes]) -> None:
        t = self.tokenizers
        a, b = t.encode([s.decode() for s in new])
        good = [b"".join([t.a_bytes[i] for i in x]) == s == b"".join([t.b_bytes[i] for i in y]) for s, x, y in zip(new, a, b, strict=True)]
        kept = [k for k, g in enumerate(good) if g]
        a_ids, b_ids = (np.array([i for k in kept for i in side[k]], np.int64) for side in (a, b))
        cuts, a_group, b_group = align(np.cumsum(t.a_length[a_ids]), np.cumsum(t.b_length[b_ids]))
        n = len(cuts)
        unit = np.searchsorted(np.cumsum([len(new[k]) for k in kept]), cuts)  # of each group
        na, nb = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        counts = np.zeros((len(new), 4), np.int64)
        per = np.zeros((len(kept), 4), np.int64)
        np.add.at(per, unit, np.stack([na, nb, np.ones(n, np.int64), na * nb], 1))
        counts[kept] = per

        group, code, times = linked(a_group, a_ids, b_group, b_ids, n)
        of, code, times = summed(np.array(kept, np.int64)[unit[group]] if n else group, code, times)
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        a_at, b_at = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (na, nb))
        groups = [f"{','.join(a_text[a_at[g] : a_at[g + 1]])}|{','.join(b_text[b_at[g] : b_at[g + 1]])}" for g in range(n)]
        at = 0
        for s, c in zip(new, counts[:, 2].tolist(), strict=True):
            self.slot[s] = len(self.text)
            self.text.append(";".join(groups[at : at + c]).encode())
            at += c
        self.counts = np.concatenate([self.counts, counts])
        self.valid = np.concatenate([self.valid, good])
        self.pairs = np.concatenate([self.pairs, self.pairs[-1] + np.cumsum(np.bincount(of, minlength=len(new)))])
        self.code, self.times = np.concatenate([self.code, code]), np.concatenate([self.times, times])


def unit_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the units of rows that each begin with a space: row starts, and every space after a character that isn't
    white space. Characters led by 0xC2 and 0xE1 to 0xE3, some of which are white space, never count as such a character;
    units are only longer for it."""
    after = np.zeros(len(buf), bool)
    after[1:] = (buf[1:] == 0x20) & (buf[:-1] > 0x20)
    after[2:] &= ~((buf[1:-1] >= 0x80) & (buf[:-2] == 0xC2))
    after[3:] &= ~((buf[2:-1] >= 0x80) & (buf[:-3] >= 0xE1) & (buf[:-3] <= 0xE3))
    after[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(after)


def unit_slots(buf: np.ndarray, start: np.ndarray, units: Units) -> np.ndarray:
    """The slot of every unit, looked up in steps of about CHUNK_BYTES."""
    end = np.append(start[1:], len(buf))
    out, at = np.zeros(len(start), np.int32), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + CHUNK_BYTES)))
        lo, hi = start[at], end[to - 1]
        strings, index = distinct(buf[lo:hi], start[at:to] - lo, end[at:to] - lo)
        out[at:to] = units.slots(strings)[index]
        at = to
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold BLOCK_BYTES."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _spans(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between successive starts, along the first axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]


class _Block:
    """The units of a block's documents; a document one of whose units doesn't come back has none."""

    def __init__(self, text: pa.ChunkedArray, units: Units):
        buf, offs = utf8(text)
        full = np.diff(offs) > 0
        buf = np.insert(buf, offs[:-1][full], 0x20)
        self.offs = offs + np.concatenate([[0], np.cumsum(full)])
        start = unit_starts(buf, self.offs)
        slots, at = unit_slots(buf, start, units), np.searchsorted(start, self.offs)
        bad = _spans(at, ~units.valid[slots].astype(bool) if len(slots) else np.zeros(0, np.int64)) > 0
        per = np.where(bad, 0, np.diff(at))
        self.slots = slots[expand(at[:-1], per)]
        self.at = np.concatenate([[0], np.cumsum(per)])
        self.counts = _spans(self.at, units.counts[self.slots])
        self.units = units

    def digest(self, k: int) -> str:
        """Of a document's groups as text; '' without tokens."""
        lo, hi = int(self.at[k]), int(self.at[k + 1])
        if lo == hi:
            return ""
        h, text = hashlib.sha256(), self.units.text
        for x in range(lo, hi, 1 << 16):
            h.update((b";" if x > lo else b"") + b";".join([text[s] for s in self.slots[x : min(hi, x + (1 << 16))].tolist()]))
        return h.hexdigest()

    def groups(self, k: int) -> str:
        return b";".join([self.units.text[s] for s in self.slots[self.at[k] : self.at[k + 1]].tolist()]).decode()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(different id pairs of the block, then by document: document, index of the pair, links)."""
        u, n_docs = self.units, len(self.at) - 1
        row = np.repeat(np.arange(n_docs), np.diff(self.at))
        key, times = np.unique(row << 32 | self.slots.astype(np.int64), return_counts=True)
        row, slot = key >> 32, key & 0xFFFFFFFF
        used = np.unique(slot)
        many = np.diff(u.pairs)
        codes, which = np.unique(u.code[expand(u.pairs[used], many[used])], return_inverse=True)
        begin = np.zeros(len(u.text), np.int64)
        begin[used] = np.cumsum(many[used]) - many[used]
        left = np.repeat(np.arange(len(slot)), many[slot])
        index = which[expand(begin[slot], many[slot])]
        links = times[left] * u.times[expand(u.pairs[slot], many[slot])]
        key, links = _summed_keys(row[left] << 32 | index, links)
        return codes, key >> 32, key & 0xFFFFFFFF, links


def _summed_keys(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
_ENCODED = f"block long, {_DOC}, groups_sha256 string, at array<int>, times array<long>, codes array<long>, docs array<long>"
_FIELDS = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
_ENCODED_ARROW = pa.schema(
    [("block", pa.int64()), *_FIELDS, ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)
_RESULT = f"{_DOC}, n_best long, count_sum long, groups_sha256 string"
_RESULT_ARROW = pa.schema([*_FIELDS[:-1], ("n_best", pa.int64()), ("count_sum", pa.int64()), _FIELDS[-1]])


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _blocks_of_units(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[tuple[pa.Table, _Block]]:
    tokenizers = tokenizers_of(first, second)
    units = Units(tokenizers)
    for table in _blocks(batches):
        if len(units.text) > UNITS:
            units = Units(tokenizers)
        yield table, _Block(table.column(1), units)


def _encode(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    """A row for each document, and after those of a block one (its codes not null) for the block."""
    block = TaskContext.get().partitionId() << 32
    for table, b in _blocks_of_units(batches, first, second):
        n = table.num_rows
        codes, row, index, links = b.pairs()
        at = np.searchsorted(row, np.arange(n + 1))
        ids = table.column(0).combine_chunks()
        arrays = [
            pa.array(np.full(n, block)), ids, *(pa.array(c) for c in b.counts.T.copy()), pa.array([b.digest(k) for k in range(n)], pa.string()),
            _lists(at, index, pa.int32()), _lists(at, links, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())),
        ]
        rows = pa.RecordBatch.from_arrays(arrays, schema=_ENCODED_ARROW)
        yield from (rows.slice(k, 256) for k in range(0, n, 256))
        own = {"block": block, "codes": codes, "docs": np.bincount(index, minlength=len(codes))}
        yield pa.RecordBatch.from_arrays([pa.array([own.get(f.name)], f.type) for f in _ENCODED_ARROW], schema=_ENCODED_ARROW)
        block += 1


def _finish(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block, with the totals of the block's pairs (at, n, best)."""
    where = pairs.column("at").to_numpy()
    n, best = np.zeros((2, int(where.max()) + 1 if len(where) else 0), np.int64)
    n[where], best[where] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    at, times = docs.column("at").combine_chunks(), docs.column("times").combine_chunks()
    index, times = at.flatten().to_numpy(), times.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
    out = {"n_best": pa.array(_spans(starts, times * best[index])), "count_sum": pa.array(_spans(starts, times * n[index]))}
    release()
    return pa.Table.from_arrays([out[f.name] if f.name in out else docs.column(f.name) for f in _RESULT_ARROW], schema=_RESULT_ARROW)


def _narrow(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _groups(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    for table, b in _blocks_of_units(batches, first, second):
        for k in range(table.num_rows):
            values = [table.column(0)[k].as_py(), *b.counts[k].tolist(), b.groups(k)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _FIELDS, strict=True)], names=[*(c for c, _ in _FIELDS[:-1]), "groups"])


def token_groups(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`, ids in order) of every whole text."""
    return _narrow(docs).mapInArrow(freed(lambda b: _groups(b, first, second)), f"{_DOC}, groups string")


def encode(docs: DataFrame, first: str, second: str, ws: Workspace) -> DataFrame:
    """Documents and blocks, written to the shared folder."""
    return ws.put(_narrow(docs).mapInArrow(freed(lambda b: _encode(b, first, second)), _ENCODED), "encoded")


def _block_pairs(encoded: DataFrame) -> DataFrame:
    """(block, at, code, docs): each block's id pairs, and how many of its documents hold them linked."""
    return encoded.filter("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("at", "p")).select("block", "at", "p.codes", "p.docs")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(codes, n, best): how many documents hold an id pair linked, and whether that is the most of any pair of its first id."""
    parts = _block_pairs(encoded).groupBy("codes", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("docs"))
    n = parts.groupBy("codes").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("codes", 32))
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(most, "a").select("codes", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_digests(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row per document: counts of tokens, groups and links, links to the first id's most frequent partners, the sum of
    the links' corpus-wide counts, and a digest of the groups."""
    ws = Workspace(docs.sparkSession)
    encoded = encode(docs, first, second, ws)
    counts = ws.put(pair_counts(encoded), "counts")
    totals = _block_pairs(encoded).join(counts, "codes").select(F.col("block").alias("of"), "at", "n", "best")
    return encoded.filter("codes is null").groupBy("block").cogroup(totals.groupBy("of")).applyInArrow(_finish, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
