"""Embedding near-dedup with navigable small-world graphs.

Vectors of one label and length are dealt by a hash into shards of about SHARD_BYTES. Each shard builds a hierarchical
navigable small-world graph, once, in a task that also answers for the shard's own vectors; the graph is then written, and
every other vector of the label queries it, in blocks of about QUERIES. A shard is as large as memory allows, so that few
graphs have to be asked. Vectors of one direction, in single precision, are one node. A query widens its beam until the
beam reaches below the threshold, and a shard doubles all beams until an audit of AUDIT vectors against brute force finds
RECALL of their links to others: first of its own vectors, then of every block's queries. A beam of 1 / WIDE of the shard or more is brute force:
such a query meets every node, whether links lead there or not. What the beams return is verified as cosine in double precision. A query reports how many vectors of the shard it links
with, and one of them for each component the shard's own links make; the components are then joined across shards.

Null labels, and vectors that are null, zero, or hold null or non-finite components, link with nothing. Equal vectors
link as any others; vectors are scaled by a power of two first, so that very small and very large ones keep their
direction. A repeated row is a vector of its own; rows with a null vec_id can't name a component that has
other names. Extra columns are left alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, expand, freed, prepare, read, shuffle_width
from .components import components

THRESHOLD = 0.93
SHARD_BYTES, QUERIES = 1 << 24, 1 << 16
LINKS, BEAM_BUILD, BEAM, EXPAND = 12, 48, 24, 4
AUDIT, RECALL = 64, 0.99
BATCH = 256
#: Beams of at least 1 / WIDE of the nodes cost more than comparing with all of them.
WIDE = 4
#: Queries answered at once; bounds the pairs held where all are linked.
ANSWER = 1024


class SmallWorld:
    """The graph of one shard; x: unit vectors, one a row."""

    def __init__(self, x: np.ndarray, seed: int = 11):
        self.x, n = np.ascontiguousarray(x, np.float32), len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(np.int64), 6)
        order = np.argsort(-self.level, kind="stable")
        order = np.concatenate([order[:1], rng.permutation(order[1:])]) if n else order
        self.entry, self.top = (int(order[0]), int(self.level[order[0]])) if n else (0, 0)
        self.near = [np.full((n, LINKS * 2 if k == 0 else LINKS), -1, np.int32) for k in range(self.top + 1)]
        at = 0
        while at < n:
            size = min(BATCH, max(32, at), n - at)
            self._insert(order[at : at + size], order[:at])
            at += size

    def _sims(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        s = np.matmul(self.x[np.maximum(ids, 0)], q[:, :, None])[:, :, 0]
        s[ids < 0] = -2
        return s

    def _insert(self, new: np.ndarray, old: np.ndarray) -> None:
        q, levels = self.x[new], self.level[new]
        starts = np.full((len(new), 1), self.entry, np.int64)
        for k in range(self.top, -1, -1):
            if len(old):
                beam = np.where(levels >= k, BEAM_BUILD, 1).max()
                starts, _ = self.search(q, starts[:, :8], k, int(beam) if k <= levels.max() else 4)
            mine = np.flatnonzero(levels >= k)
            if not len(mine):
                continue
            found = starts[mine] if len(old) else np.full((len(mine), 1), -1)
            among = q[mine] @ q[mine].T
            np.fill_diagonal(among, -2)
            c = min(len(mine), BEAM_BUILD)
            own = np.argpartition(-among, c - 1, axis=1)[:, :c]
            ids = np.concatenate([found, np.where(np.take_along_axis(among, own, 1) > -2, new[mine][own], -1)], axis=1)
            width = self.near[k].shape[1]
            chosen = self._select(q[mine], ids, LINKS)
            self.near[k][new[mine], : chosen.shape[1]] = chosen
            self._link_back(k, new[mine], chosen, width)

    def _select(self, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of ids for each q: nearest first, each nearer to q than to those chosen; then the nearest left."""
        sims = self._sims(q, ids)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        n = len(q)
        out, count, taken = np.full((n, most), -1, np.int64), np.zeros(n, np.int64), np.zeros(ids.shape, bool)
        every = np.arange(n)
        for j in range(ids.shape[1]):
            v = self.x[np.maximum(ids[:, j], 0)]
            close = self._sims(v, out).max(axis=1)
            ok = (ids[:, j] >= 0) & (count < most) & (sims[:, j] > close)
            out[every[ok], count[ok]] = ids[ok, j]
            taken[ok, j] = True
            count += ok
        for j in range(ids.shape[1]):
            ok = (ids[:, j] >= 0) & (count < most) & ~taken[:, j]
            out[every[ok], count[ok]] = ids[ok, j]
            count += ok
        return out

    def _link_back(self, k: int, new: np.ndarray, chosen: np.ndarray, width: int) -> None:
        to, frm = chosen.ravel(), np.repeat(new, chosen.shape[1])
        to, frm = to[to >= 0], frm[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        for size in np.unique(counts).tolist():  # a block of targets with as many new links
            which = np.flatnonzero(counts == size)
            ids = frm[first[which][:, None] + np.arange(size)]
            old = self.near[k][targets[which]].astype(np.int64)
            repeat = (ids[:, :, None] == old[:, None, :]).any(axis=2)
            both = np.concatenate([old, np.where(repeat, -1, ids)], axis=1)
            free = (both >= 0).sum(axis=1) <= width
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :width]
            if not free.all():
                full = ~free
                packed[full] = self._select(self.x[targets[which[full]]], both[full], width)
            self.near[k][targets[which], : packed.shape[1]] = packed

    def search(self, q: np.ndarray, starts: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest nodes of layer k found for each query, with their similarities (-1 and -2: none)."""
        m = len(q)
        beam = max(beam, starts.shape[1])
        ids = np.full((m, beam), -1, np.int64)
        ids[:, : starts.shape[1]] = starts
        sims = self._sims(q, ids)
        seen = np.zeros((m, len(self.x) + 1), bool)
        np.put_along_axis(seen, np.where(ids < 0, len(self.x), ids), True, 1)
        opened = ids < 0
        live = np.arange(m)
        while len(live):
            score = np.where(opened[live], -3, sims[live])
            e = min(EXPAND, beam)
            pick = np.argpartition(-score, e - 1, axis=1)[:, :e]
            good = np.take_along_axis(score, pick, 1) > -2
            go = good.any(axis=1)
            live, pick, good = live[go], pick[go], good[go]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            nodes = np.where(good, ids[live[:, None], pick], -1)
            cand = np.where((nodes >= 0)[:, :, None], self.near[k][np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            spot = np.where(cand < 0, len(self.x), cand)
            cand[seen[live[:, None], spot]] = -1
            seen[live[:, None], spot] = True
            s = self._sims(q[live], cand)
            all_ids = np.concatenate([ids[live], cand], axis=1)
            all_sims = np.concatenate([sims[live], s], axis=1)
            all_open = np.concatenate([opened[live], cand < 0], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], opened[live] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs at least about `least` similar; beams widen until they reach below it or meet all nodes."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        q = np.ascontiguousarray(q, np.float32)
        for a in range(0, len(q), BATCH):
            left = np.arange(a, min(a + BATCH, len(q)))
            starts = np.full((len(left), 1), self.entry, np.int64)
            for k in range(self.top, 0, -1):
                starts = self.search(q[left], starts, k, 2)[0]
            width = min(beam, len(self.x))
            while len(left):
                if WIDE * width >= len(self.x):
                    row, col = np.nonzero(q[left] @ self.x.T >= least)
                    out.append((left[row], col))
                    break
                ids, sims = self.search(q[left], starts, 0, width)
                done = sims[:, -1] < least
                hit = (sims >= least) & (ids >= 0) & done[:, None]
                row, col = np.nonzero(hit)
                out.append((left[row], ids[row, col]))
                left, starts = left[~done], ids[~done]
                width = min(4 * width, len(self.x))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Shard:
    """A graph with audited beams, exact vectors for verification, and the components of its own links."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, threshold: float):
        self.rows, self.v, self.threshold = np.asarray(rows, np.int64), vectors, threshold
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        x = (vectors / self.norm[:, None]).astype(np.float32)
        _, first, node = np.unique(x, axis=0, return_index=True, return_inverse=True)
        self.graph = SmallWorld(x[first])
        self.of = np.argsort(node, kind="stable")  # rows by node
        self.copies = np.bincount(node)
        self.first = np.cumsum(self.copies) - self.copies
        self.beam = self._audited()
        self.inner = np.zeros(len(rows), np.int64)
        self.root = np.arange(len(rows))
        for at in range(0, len(rows), ANSWER):
            a, b = self.linked(vectors[at : at + ANSWER], self.norm[at : at + ANSWER])
            a += at
            own = a != b
            self.inner += np.bincount(a[own], minlength=len(rows))
            self._join(a[own], b[own])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every row's root becomes the least row of its component, now that each a is linked with its b."""
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            if not len(a):
                return
            np.minimum.at(self.root, a, b)
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up

    def _found(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs that the graph finds for unit vectors, before verification."""
        i, j = self.graph.within(x, self.threshold - 1e-5, beam)
        return np.repeat(i, self.copies[j]), self.of[expand(self.first[j], self.copies[j])]

    def _audited(self) -> int:
        some = np.linspace(0, len(self.rows) - 1, min(AUDIT, len(self.rows))).astype(np.int64)
        return self._widened(self.v[some], self.norm[some], some, min(BEAM, len(self.copies)))

    def audit(self, q: np.ndarray, norm: np.ndarray) -> None:
        """Widens the beams until some of these queries, of other shards, find RECALL of their links too."""
        some = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64)
        self.beam = self._widened(q[some], norm[some], None, self.beam)

    def _widened(self, q: np.ndarray, norm: np.ndarray, own: np.ndarray | None, beam: int) -> int:
        true = (q @ self.v.T) / (norm[:, None] * self.norm) >= self.threshold
        if own is not None:
            true[np.arange(len(own)), own] = False
        while beam < len(self.copies) and true[self._found(q / norm[:, None], beam)].sum() < RECALL * true.sum():
            beam = min(2 * beam, len(self.copies))
        return beam

    def linked(self, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of cosine >= threshold in double precision."""
        i, j = self._found(q / norm[:, None], self.beam)
        keep = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 15):
            p = slice(a, a + (1 << 15))
            keep[p] = np.einsum("ij,ij->i", q[i[p]], self.v[j[p]]) / (norm[i[p]] * self.norm[j[p]]) >= self.threshold
        return i[keep], j[keep]


OUT = "row_id long, links long, other array<long>"


def _report(shard: Shard, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Links of each query row, and a vector of each component of the shard it links with."""
    pairs = np.unique(i * np.int64(len(shard.rows)) + shard.root[j])
    a, r = pairs // len(shard.rows), pairs % len(shard.rows)
    ends = np.searchsorted(a, np.arange(len(rows) + 1))
    other = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shard.rows[r]))
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(i, minlength=len(rows)).astype(np.int64)), other], names=["row_id", "links", "other"])


GRAPH = "label string, size int, shard int, graph binary"


def _scaled(flat: np.ndarray, size: int) -> np.ndarray:
    """Vectors, a row each, by powers of two to components of about 1."""
    v = flat.reshape(-1, size)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(key, whether it is a new one, slice of a batch with that key) of rows sorted by names."""
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        at = 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            yield keys[at], keys[at] != last, batch.slice(at, to - at)
            last, at = keys[at], to


def _vectors(part: pa.RecordBatch, size: int) -> np.ndarray:
    return _scaled(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64), size)


BUILT = f"{OUT}, {GRAPH}"
_BUILT = pa.schema([("row_id", pa.int64()), ("links", pa.int64()), ("other", pa.list_(pa.int64())), ("label", pa.string()), ("size", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())])


def _build(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Graphs of the shards that others ask, and what each shard's own vectors link with. Rows come sorted by shard."""
    rows: list[np.ndarray] = []
    vectors: list[np.ndarray] = []

    def settle() -> Iterator[pa.RecordBatch]:
        label, size, nth, asked = key
        shard = Shard(np.concatenate(rows), np.concatenate(vectors), threshold)
        own = _own(shard)
        none = [pa.nulls(own.num_rows, t) for t in (pa.string(), pa.int32(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*own.columns, *none], schema=_BUILT)
        if asked:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([label]), pa.array([size], pa.int32()), pa.array([nth], pa.int32()), pa.array([pickle.dumps(shard)], pa.binary())], schema=_BUILT)

    key = None
    for found, fresh, part in _grouped(batches, ("label", "size", "shard", "asked")):
        if fresh and key:
            yield from settle()
            rows, vectors = [], []
        key = found
        rows.append(part.column("row_id").to_numpy())
        vectors.append(_vectors(part, key[1]))
    if key:
        yield from settle()


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (label, size, shard, block): a shard's graph, then the queries of one block."""
    shard, checked = None, False
    for key, _, part in _grouped(batches, ("label", "size", "shard", "block")):
        if part.column("graph")[0].is_valid:
            shard, checked = pickle.loads(part.column("graph")[0].as_py()), False
            part = part.slice(1)
        for a in range(0, part.num_rows, ANSWER):
            some = part.slice(a, ANSWER)
            q = _vectors(some, key[1])
            norm = np.sqrt((q * q).sum(axis=1))
            if not checked:
                shard.audit(q, norm)
                checked = True
            yield _report(shard, some.column("row_id").to_numpy(), *shard.linked(q, norm))


def _own(shard: Shard) -> pa.RecordBatch:
    """The shard's own vectors: their links inside it, and the root of their component."""
    n = len(shard.rows)
    other = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(shard.rows[shard.root]))
    return pa.RecordBatch.from_arrays([pa.array(shard.rows), pa.array(shard.inner.astype(np.int64)), other], names=["row_id", "links", "other"])


def embedding_dedup(table: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES, queries: int = QUERIES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table (vec_id, embedding, label)."""
    spark = table.sparkSession
    prepare(spark)
    ws = Workspace(spark)
    narrow = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = ws.put(narrow.withColumn("row_id", F.monotonically_increasing_id()), "vectors")
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = rows.filter(F.col("label").isNotNull() & F.forall("vector", real) & F.exists("vector", lambda v: v != 0)).withColumn("size", F.size("vector"))
    counts = usable.groupBy("label", "size").agg(F.count("*").alias("c"))
    counts = counts.select("label", "size", F.ceil(F.col("c") * F.col("size") * 8 / shard_bytes).cast("int").alias("shards"), F.ceil(F.col("c") / queries).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("row_id", F.lit(1)), F.col("shards")).cast("int")
    its_block = F.pmod(F.xxhash64("row_id", F.lit(2)), F.col("blocks")).cast("int")
    dealt = usable.join(counts, ["label", "size"]).withColumns({"own": own, "its_block": its_block})
    where = ["label", "size", "shard"]
    index = dealt.select("label", "size", F.col("own").alias("shard"), (F.col("shards") > 1).alias("asked"), "row_id", "vector")
    index = index.repartition(shuffle_width(spark), *where).sortWithinPartitions(*where, "row_id")
    built = ws.put(index.mapInArrow(freed(lambda b: _build(b, threshold)), BUILT), "graphs")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    graphs = built.filter("graph is not null").join(counts, ["label", "size"]).select(*where, each("blocks").alias("block"), F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("array<double>").alias("vector"), "graph")
    asking = dealt.filter("shards > 1").select("label", "size", each("shards").alias("shard"), F.col("its_block").alias("block"), "row_id", "vector", F.lit(None).cast("binary").alias("graph"), "own").filter("own <> shard").drop("own")
    where.append("block")
    tasks = graphs.unionByName(asking).repartition(shuffle_width(spark), *where).sortWithinPartitions(*where, F.col("row_id").asc_nulls_first())
    answers = ws.put(tasks.mapInArrow(freed(_ask), OUT), "answers")
    found = built.filter("row_id is not null").select("row_id", "links", "other").unionByName(answers)
    links = found.select(F.col("row_id").alias("a"), F.explode("other").alias("b"))
    roots = components(links, ws).select(F.col("node").alias("row_id"), "root")
    total = found.groupBy("row_id").agg(F.sum("links").alias("n_links"))
    named = rows.select("row_id", "vec_id").join(total, "row_id", "left").join(roots, "row_id", "left")
    named = ws.put(named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "row_id").alias("root")), "rooted")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "root")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))
