"""Byte-level BPE, encoding and decoding whole batches of texts in numpy.

Texts are cut by the byte-level pattern with array operations on character classes. The distinct pieces of a chunk
that the worker has not met lately are merged together: all their symbols lie in one flat array, each round looks every
neighbouring pair up by binary search over the sorted pair keys, every piece merges its lowest-ranked pair wherever it
occurs (left to right), and pieces without a known pair leave. Pieces of more than LONG symbols take their merges from
a heap instead. Pieces are compared as bytes, never by hashes. Decoding gathers the ids' bytes from one flat table.

The file is one of the tokenizers library with a byte-level model and no normaliser; as there, the strings of added
tokens inside a text become those tokens. A null text is empty, repeated rows are rows of their own, extra columns are
left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, expand, freed, prepare, read, slices, utf8

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Different pieces, and their bytes, that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 500_000, 32 << 20
#: Pieces of more symbols are merged alone, by a heap: a common round would scan them once for every merge.
LONG = 256
#: Code points with the property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable, else the next code point from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], order.astype(np.int64), made[order]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_re = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        table = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        table |= {i: t.encode() for t, i in self.added.items()}
        self.id_length = np.zeros(max(table) + 1, np.int64)
        for i, b in table.items():
            self.id_length[i] = len(b)
        self.id_start = np.concatenate([[0], np.cumsum(self.id_length)[:-1]])
        self.id_bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(self.id_length))), np.uint8)
        self.classes = character_classes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_ids = self.n_pieces = 0

    # --- pieces

    def _characters(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte position, code point) of each character."""
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        lead = buf[at].astype(np.int64)
        code = lead.copy()
        if len(at) < len(buf):
            pad = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
            for low, high, n, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
                which = np.flatnonzero((lead >= low) & (lead < high))
                value = lead[which] & bits
                for k in range(n):
                    value = value << 6 | pad[at[which] + k + 1]
                code[which] = value
        return at, code

    def pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte (start, end) of all pieces of the rows that offs cuts buf into."""
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, code = self._characters(buf)
        kind = self.classes[np.minimum(code, 0x10FFFF)]
        n = len(at)
        row_first = np.zeros(n + 1, bool)
        row_first[np.searchsorted(at, offs[offs < len(buf)])] = True
        row_first[n] = True
        run = row_first.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        begins = run.copy()
        # white space before something else: its last character stands alone, or joins what follows if it is a blank
        nxt = np.flatnonzero(run[1:n] & ~row_first[1:n]) + 1
        nxt = nxt[kind[nxt - 1] == SPACE]
        begins[nxt - 1] = True
        joined = nxt[code[nxt - 1] == 0x20]
        begins[joined] = False
        # contractions: an apostrophe that begins a piece, then one of s t m d re ve ll
        quote = np.flatnonzero((code == 0x27) & begins[:n])
        quote = quote[quote + 1 < n]
        quote = quote[~row_first[quote + 1]]
        one = code[quote + 1]
        single = quote[np.isin(one, [ord(c) for c in "stmd"])]
        rest = quote[quote + 2 < n]
        rest = rest[~row_first[rest + 2]]
        a, b = code[rest + 1], code[rest + 2]
        double = rest[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        for which, size in ((single, 2), (double, 3)):
            begins[which + 1] = False
            begins[which + size] = True
        first = np.flatnonzero(begins[:n])
        start = at[first]
        return start, np.concatenate([start[1:], [len(buf)]])

    # --- merges

    def _merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids and their number for each of many pieces, merged in common rounds."""
        n, keys, never = len(lengths), self.pair_keys, np.int64(1 << 40)
        done_ids: list[np.ndarray] = []
        done_of: list[np.ndarray] = []
        piece = np.repeat(np.arange(n), lengths)
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = (keys[spot] == key) & (piece[:-1] == piece[1:])
            ranks = np.full(len(symbols), never)
            ranks[:-1] = np.where(ok, self.pair_rank[spot], never)
            head = np.concatenate([[True], piece[1:] != piece[:-1]])
            heads = np.flatnonzero(head)
            least = np.minimum.reduceat(ranks, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            live = np.repeat(least < never, sizes)
            if not live.all():
                done_ids.append(symbols[~live])
                done_of.append(piece[~live])
                spot = np.append(spot, 0)[live]
                symbols, piece, ranks, least = symbols[live], piece[live], ranks[live], np.repeat(least, sizes)[live]
                if not len(symbols):
                    break
            else:
                spot, least = np.append(spot, 0), np.repeat(least, sizes)
            hit = ranks == least
            # the same pair twice in a row, as in aaa: every second one of such a run
            both = np.flatnonzero(hit[1:] & hit[:-1])
            if len(both):
                where = np.arange(len(hit))
                first = hit & ~np.concatenate([[False], hit[:-1]])
                run = np.maximum.accumulate(np.where(first, where, -1))
                hit &= (where - run) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.pair_made[spot[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, piece = symbols[keep], piece[keep]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        of = np.concatenate(done_of) if done_of else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=n)

    def _symbols(self, buf: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.byte_id[buf[expand(start, lengths)]]

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The final ids of one long piece: a heap of (rank, place) over a linked list."""
        if not hasattr(self, "by_pair"):
            self.by_pair = dict(zip(self.pair_keys.tolist(), zip(self.pair_rank.tolist(), self.pair_made.tolist(), strict=True), strict=True))
        known, n = self.by_pair, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (hit := known.get(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j] = known[a << 32 | b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n and (hit := known.get(symbols[at] << 32 | symbols[after[at]])):
                    heapq.heappush(heap, (hit[0], at, symbols[at], symbols[after[at]]))
        return [s for s in symbols if s >= 0]

    def _learn(self, strings: list[bytes]) -> None:
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        starts = np.cumsum(lengths) - lengths
        symbols = self._symbols(np.frombuffer(b"".join(strings), np.uint8), starts, lengths)
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            short = lengths <= LONG
            ids, of = self._merge(symbols[np.repeat(short, lengths)], lengths[short])
            parts, counts = [ids], np.zeros(len(strings), np.int64)
            counts[short] = of
            for k in long.tolist():
                alone = self._merge_long(symbols[starts[k] : starts[k] + lengths[k]].tolist())
                parts.append(np.array(alone, np.int64))
                counts[k] = len(alone)
            ids = np.concatenate(parts)
            order = np.concatenate([np.flatnonzero(short), long])
            at = np.zeros(len(strings), np.int64)
            at[order] = np.cumsum(counts[order]) - counts[order]
        else:
            ids, counts = self._merge(symbols, lengths)
            at = np.cumsum(counts) - counts
        n, m = len(ids), len(counts)
        while self.n_ids + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_pieces + m > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.n_ids : self.n_ids + n] = ids
        self.lengths[self.n_pieces : self.n_pieces + m] = counts
        self.starts[self.n_pieces : self.n_pieces + m] = self.n_ids + at
        self.known.update(zip(strings, range(self.n_pieces, self.n_pieces + m), strict=True))
        self.held += int(lengths.sum())
        self.n_ids, self.n_pieces = self.n_ids + n, self.n_pieces + m

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets by row) of rows without added tokens."""
        start, end = self.pieces(buf, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        strings, back = distinct(buf, start, end)
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget()
        get = self.known.get
        index = np.fromiter((get(w, -1) for w in strings), np.int64, len(strings))
        new = np.flatnonzero(index < 0)
        if len(new):
            base = self.n_pieces
            self._learn([strings[k] for k in new.tolist()])
            index[new] = np.arange(base, base + len(new))
        index = index[back]
        lengths = self.lengths[index]
        ids = self.ids[expand(self.starts[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.searchsorted(start, offs, "left")]

    def encode_rows(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each row, added tokens included."""
        rows: list[np.ndarray] = []
        if self.added_re:
            found = {}
            whole = buf.tobytes()
            if any(t.encode() in whole for t in self.added):
                for r in range(len(offs) - 1):
                    text = whole[offs[r] : offs[r + 1]].decode("utf-8", "surrogatepass")
                    if self.added_re.search(text):
                        found[r] = self._split(text)
            if found:
                plain = np.array([r not in found for r in range(len(offs) - 1)])
                sizes = np.where(plain, np.diff(offs), 0)
                kept = buf[np.repeat(plain, np.diff(offs))]
                rows = self.encode_rows_plain(kept, np.concatenate([[0], np.cumsum(sizes)]))
                for r, ids in found.items():
                    rows[r] = ids
                return rows
        return self.encode_rows_plain(buf, offs)

    def encode_rows_plain(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        ids, at = self.encode(buf, offs)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _split(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in [*self.added_re.finditer(text), None]:
            part = np.frombuffer(text[at : m.start() if m else len(text)].encode("utf-8", "surrogatepass"), np.uint8)
            out.append(self.encode(part, np.array([0, len(part)]))[0])
            if m:
                out.append(np.array([self.added[m[0]]], np.int32))
                at = m.end()
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become replacement characters."""
        raw = self.id_bytes[expand(self.id_start[ids], self.id_length[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


_MODELS: dict[str, ByteBPE] = {}


def model(path: str) -> ByteBPE:
    if path not in _MODELS:
        _MODELS[path] = ByteBPE(path)
    return _MODELS[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = model(path)
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        counts, ids_hash, text_hash = [], [], []
        for a, b in slices(offs, 4 << 20):
            for ids in bpe.encode_rows(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]):
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], schema=_OUT)


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = model(path)
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        for a, b in slices(offs, 4 << 20):
            rows = bpe.encode_rows(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _narrow(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; path names a file that every executor has."""
    return _narrow(docs).mapInArrow(freed(lambda b: _ids(b, path)), "doc_id long, ids array<int>")


def codec_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text encoded and decoded again."""
    return _narrow(docs).mapInArrow(freed(lambda b: _digests(b, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return codec_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
