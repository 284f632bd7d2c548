"""N-gram Jaccard join in metric space.

Jaccard distance over sets of word shingles is a metric; two sets link within radius r. Linked sets share one of the
first few shingles of each in any common order, so sets meet in groups by those shingles, rarest first, and by size: their
sizes differ by a factor below 1 - r, so a set enters the rings of its own and the next logarithmic size. That spares the
join the pairs at distance near 1, for which no pivot is any help (nearly all distances of a corpus are), and loses no link.
Every group is then resolved by pivots:

1. Every group takes a pivot, its least member by a hash, which a family's groups mostly agree on. All distances to it
   are found, which settles the pivot; sets that turn out connected need no further comparison.
2. Groups that still hold several components and more than LEAF sets merge with those of the same pivot: one family has
   many almost equal groups. Pivots then create Voronoi regions: every set belongs to its nearest pivot. By the triangle
   inequality a linked set of another region is at most 2 r further from that pivot than from its own, so boundary sets
   within this window are replicated into that region. Regions join recursively, until they hold LEAF sets or nothing
   that isn't connected; a round whose regions would hold more than SPREAD times its sets compares its pivots with all
   and goes on without them.
3. A group of up to MOST sets recurses inside one task, on the sets' counts over BUCKETS hash buckets of their shingles. The
   Jaccard distance of such counts (1 - sum of least / sum of largest) is a metric as well and never above the
   distance of the sets, so every pair within r is within r there, and the same windows hold. Only pairs found within r
   leave the task. Larger groups recurse over the cluster, by exact distances. Either way distances are capped (a capped
   metric is a metric), and sets that are no nearer to any pivot than the cap less r make one more region.

Groups with the same members, as one family makes by each of its shingles, count once. Every link comes from the complete
sets, which are fetched for the pairs that the counts leave.

Words are lower-cased (A-Z) runs without ASCII white space; a set holds the distinct shingles, the whole sequence if it
is shorter than one, nothing without words. A null text is empty and links with nothing, as do empty sets. Rows with
equal sets, repeated rows among them, are one class of distance 0. A null doc_id can't be a component's name unless no
member has one. Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Workspace, freed, mix, prepare, read, shuffle_width, slices, tidy, utf8, word_hashes, words
from .components import components

WORDS = 3
#: Two sets link when per_hundred * union <= 100 * intersection; the query's value.
PER_HUNDRED = 90
#: Sets that are compared pair by pair; sets that one task resolves, a bound on its memory (512 bytes each).
LEAF, MOST = 16, 1 << 13
#: Pivots of a round over the cluster, and of one inside a task.
PIVOTS, TASK_PIVOTS = 64, 8
SPREAD = 1.5
CAP = 0.3
BUCKETS = 128
#: Parts in which texts are sent to become sets, and the share of all sets' shingles that pairs measured at once may hold:
#: both bound the shuffle files that lie beside the sets.
TEXT_PARTS, MEASURED = 3, 0.5
#: Pairs of more shingles are first compared by every SLICE-th bucket's: in long sets all bucket counts are alike.
LONG, SLICE = 2048, 4
#: Pairs whose ids, of 8 bytes, may be broadcast.
BROADCAST_IDS = 1 << 20
#: Shingles told apart as frequent; they only decide which shingles come last in the order.
FREQUENT = 1 << 16

_C = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)]


def shingles(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, letters) of all word shingles of all rows, with repetitions."""
    buf = LOWER[buf]
    start, end, row = words(buf, offs)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, size = word_hashes(buf, start, end), end - start
    n = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    width = np.minimum(n, k)  # of the shingles of a row
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    of = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) + first[of]
    value = np.zeros(len(of), np.uint64)
    letters = np.zeros(len(of), np.int64)
    for j in range(k):
        have = width[of] > j
        value[have] = mix(value[have] * _C[0] + h[at[have] + j] + _C[1])
        letters[have] += size[at[have] + j]
    return of, value, letters


class Order:
    """A total order of shingles: longest first, since they are rare, and known frequent ones last by frequency."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.frequent = frequent[order]
        self.level = (128 + np.minimum(127, 6 * np.log2(np.maximum(counts[order], 1)))).astype(np.uint64)

    def __call__(self, value: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The shingle's identity here: 8 bits of rank, then 56 of hash; sorts in the order."""
        rank = (127 - np.minimum(letters, 127)).astype(np.uint64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, value), len(self.frequent) - 1)
            known = self.frequent[at] == value
            rank[known] = self.level[at[known]]
        return rank << np.uint64(56) | value >> np.uint64(8)


def sets_of(buf: np.ndarray, offs: np.ndarray, order: Order, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(members of all rows' sets in order, row offsets)."""
    row, value, letters = shingles(buf, offs, k)
    key = order(value, letters)
    by = np.lexsort((key, row))
    row, key = row[by], key[by]
    new = np.ones(len(key), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    row, key = row[new], key[new]
    return key, np.searchsorted(row, np.arange(len(offs)))


def _frequent(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingles of at least a thousandth of a block's rows, with their counts there."""
    held: list[np.ndarray] = []
    rows = size = 0

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= max(4, rows // 1000)
        return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["value", "n"])

    for batch in batches:
        buf, offs = utf8(batch.column(0))
        for a, b in slices(offs):
            row, value, _ = shingles(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
            held.append(value)
            rows, size = rows + b - a, size + len(value)
            if size > 1 << 22:
                yield flush()
                held, rows, size = [], 0, 0
    if held:
        yield flush()


_ROWS = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.list_(pa.int64()))])
ROWS = "row_id long, doc_id long, row_key long, n long, f1 long, f2 long, prefix array<long>"


def _rows(batches: Iterator[pa.RecordBatch], order: Order, k: int, per_hundred: int) -> Iterator[pa.RecordBatch]:
    """Each row's set size, fingerprint and first shingles."""
    row_id = TaskContext.get().partitionId() << 36
    for batch in batches:
        buf, offs = utf8(batch.column(2))
        for a, b in slices(offs):
            key, at = sets_of(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order, k)
            n = np.diff(at)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key * c + c))]) for c in _C[:2]]
            f1, f2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            take = np.where(n > 0, n - -(-per_hundred * n // 100) + 1, 0)
            ends = np.concatenate([[0], np.cumsum(take)])
            index = np.arange(ends[-1]) - np.repeat(ends[:-1], take) + np.repeat(at[:-1], take)
            prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key[index].view(np.int64)))
            m = b - a
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row_id, row_id + m)), batch.column(0).slice(a, m), batch.column(1).slice(a, m), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), prefix], schema=_ROWS)
            row_id += m


NODES = "node long, n long, buckets array<int>, members array<long>"


def _nodes(batches: Iterator[pa.RecordBatch], order: Order, k: int) -> Iterator[pa.RecordBatch]:
    """The whole set of each node; a repeated row comes again, mostly next to the first, and is passed over there."""
    last = None
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        fresh = np.append(True, ids[1:] != ids[:-1])
        fresh[0] = ids[0] != last
        last = ids[-1]
        batch = batch.filter(pa.array(fresh))
        buf, offs = utf8(batch.column(1))
        for a, b in slices(offs):
            key, at = sets_of(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order, k)
            m = b - a
            row = np.repeat(np.arange(m), np.diff(at))
            counts = np.bincount(row * BUCKETS + (key % np.uint64(BUCKETS)).astype(np.int64), minlength=m * BUCKETS).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * BUCKETS, BUCKETS, dtype=np.int32)), pa.array(counts))
            members = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(np.diff(at).astype(np.int64)), buckets, members], names=["node", "n", "buckets", "members"])


def _least_overlap(cap: float, o: Column, sizes: Column) -> Column:
    """Whether an overlap of o can mean a distance of cap or less: (2 - cap) o >= (1 - cap) (n_x + n_p)."""
    return (F.lit(2 - cap) * o) >= (F.lit(1 - cap) * sizes - 1e-6)


def _near(pairs: DataFrame, nodes: DataFrame, cap: float) -> DataFrame:
    """The pairs (x, p) that the bounds leave, with n_x and n_p. The overlap is at most the smaller set, and at most the
    sum of the smaller bucket counts."""
    side = lambda c: nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "buckets")))
    near = pairs.join(side("x"), "x").join(side("p"), "p")
    sizes = F.col("n_x") + F.col("n_p")
    near = near.filter(_least_overlap(cap, F.least("n_x", "n_p"), sizes))
    bound = F.aggregate(F.zip_with("buckets_x", "buckets_p", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    return near.filter(_least_overlap(cap, bound, sizes)).select("x", "p", "n_x", "n_p")


_NEAR = pa.schema([("x", pa.int64()), ("p", pa.int64()), ("n_x", pa.int64()), ("n_p", pa.int64())])


class Regions:
    """The recursive join of one group inside a task; counts: its sets' shingles by bucket, root: their components."""

    def __init__(self, counts: np.ndarray, root: np.ndarray, r: float):
        self.root, self.r = root, r
        self.n = counts.sum(axis=1, dtype=np.int64)
        self.counts = counts.astype(np.int16) if counts.max(initial=0) < 1 << 15 else counts
        self.out: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0

    def _distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Jaccard distances of counts, i x j."""
        out = np.empty((len(i), len(j)))
        step = max(1, (1 << 20) // (max(1, len(j)) * BUCKETS))
        for a in range(0, len(i), step):
            k = i[a : a + step]
            least = np.minimum(self.counts[k][:, None, :], self.counts[j][None, :, :]).sum(axis=2, dtype=np.int64)
            out[a : a + step] = 1 - least / (self.n[k][:, None] + self.n[j][None, :] - least)
        self.compared += len(i) * len(j)
        return out

    def _keep(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        a, b = np.nonzero((d <= self.r + 1e-9) & (self.root[i][:, None] != self.root[j][None, :]) & (i[:, None] != j[None, :]))
        self.out.append((np.minimum(i[a], j[b]), np.maximum(i[a], j[b])))

    def join(self, of: np.ndarray) -> Regions:
        """Finds the pairs of different components within r among the sets `of`."""
        todo = [of]
        while todo:
            of = todo.pop()
            if len(of) < 2 or (self.root[of] == self.root[of[0]]).all():
                continue
            if len(of) <= LEAF:
                self._keep(of, of, self._distances(of, of))
                continue
            # members of small components first: once all but one component have been pivots, nothing is open
            _, at, own = np.unique(self.root[of], return_inverse=True, return_counts=True)
            order = np.argsort(own[at], kind="stable")
            small = order[: TASK_PIVOTS // 2]
            spread = order[np.linspace(0, len(of) - 1, TASK_PIVOTS - len(small)).astype(np.int64)]
            chosen = np.unique(np.concatenate([small, spread]))
            pivots = of[chosen]
            d = self._distances(of, pivots)
            self._keep(of, pivots, d)
            rest = np.ones(len(of), bool)
            rest[chosen] = False
            rest, d = of[rest], d[rest]
            own, cap = d.min(axis=1), min(1.0, 3 * self.r)
            inside = (d < cap) & (d <= own[:, None] + 2 * self.r + 1e-9)
            far = own >= cap - self.r - 1e-9
            if inside.sum() + far.sum() > SPREAD * len(rest):
                todo.append(rest)
            else:
                todo += [rest[inside[:, k]] for k in range(len(pivots))] + [rest[far]]
        return self


def _regions(batches: Iterator[pa.RecordBatch], r: float) -> Iterator[pa.RecordBatch]:
    """Near pairs of each group, of at most MOST sets; rows come sorted by group."""
    held: list[tuple] = []
    key = None

    def settle() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        x, root, n = (np.array([h[k] for h in held], np.int64) for k in range(3))
        found = Regions(np.array([h[3] for h in held], np.int32), root, r).join(np.arange(len(held))).out
        if not found:
            return
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        pair = np.unique(a * np.int64(len(x)) + b)
        a, b = pair // len(x), pair % len(x)
        a, b = np.where(x[a] < x[b], a, b), np.where(x[a] < x[b], b, a)
        yield pa.RecordBatch.from_arrays([pa.array(x[a]), pa.array(x[b]), pa.array(n[a]), pa.array(n[b])], schema=_NEAR)

    for batch in batches:
        g, x, root, n = (batch.column(k).to_pylist() for k in ("g", "x", "root", "n"))
        buckets = batch.column("buckets").flatten().to_numpy(zero_copy_only=False).reshape(-1, BUCKETS)
        for k in range(len(g)):
            if g[k] != key:
                yield from settle()
                held, key = [], g[k]
            held.append((x[k], root[k], n[k], buckets[k]))
    yield from settle()


def _near_within(groups: DataFrame, nodes: DataFrame, r: float) -> DataFrame:
    """The near pairs (x, p, n_x, n_p) of different components inside groups (g, x, root)."""
    spark = groups.sparkSession
    known = nodes.select(F.col("node").alias("x"), "n", "buckets")
    rows = groups.select("g", "x", "root").join(known, "x").repartition(shuffle_width(spark), "g").sortWithinPartitions("g", "x")
    return rows.mapInArrow(freed(lambda b: _regions(b, r)), "x long, p long, n_x long, n_p long").distinct()


def _parts(pairs: DataFrame, moved: float, room: float) -> list[DataFrame]:
    """pairs (x, ..) dealt by x into parts that move about `room` of `moved`, one at least."""
    parts = max(1, math.ceil(moved / max(1.0, room)))
    return [pairs.filter(F.pmod(F.xxhash64("x", F.lit(3)), F.lit(parts)) == k) for k in range(parts)]


def _nearer(near: DataFrame, nodes: DataFrame, ws: Workspace, cap: float, room: float) -> DataFrame:
    """near without the pairs of long sets that a closer bound parts by more than cap: the overlap is at most that of the shingles
    in every SLICE-th bucket, which is found, and the sum of the smaller counts of all other buckets. Loses no pair within cap."""
    long = F.col("n_x") + F.col("n_p") > LONG
    moved = near.filter(long).agg(F.sum(F.col("n_x") + F.col("n_p"))).first()[0]
    if not moved:
        return near
    own = F.filter("members", lambda m: m.bitwiseAND(F.lit(SLICE - 1)) == 0)
    others = F.filter("buckets", lambda b, i: i % SLICE != 0)

    def closer(part: DataFrame) -> DataFrame:
        def side(c: str) -> DataFrame:
            asked = nodes.join(part.select(F.col(c).alias("node")).distinct(), "node", "left_semi")
            return asked.select(F.col("node").alias(c), own.alias(f"own_{c}"), others.alias(f"others_{c}"))

        both = F.size(F.array_intersect("own_x", "own_p"))
        rest = F.aggregate(F.zip_with("others_x", "others_p", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
        met = part.join(side("x"), "x").join(side("p"), "p")
        return met.filter(_least_overlap(cap, both + rest, F.col("n_x") + F.col("n_p"))).select(*near.columns)

    out = ws.put_each([near.filter(~long), *map(closer, _parts(near.filter(long), moved / SLICE, room))], "nearer")
    ws.drop(near)
    return out


def _measure(near: DataFrame, nodes: DataFrame, ws: Workspace, per_hundred: int, shingles_of_all: int, cap: float) -> DataFrame:
    """(x, p, linked, d) of the near pairs within cap, and of some others; d is exact. Sets travel once a pair, so pairs are
    measured part by part, dealt by x."""
    near = _nearer(ws.put(near, "near"), nodes, ws, cap, MEASURED * shingles_of_all)
    pairs, moved = near.agg(F.count("*"), F.sum(F.col("n_x") + F.col("n_p"))).first()
    # only the sets that a side asks for travel; up to BROADCAST_IDS ids are sent to them, more meet them in a shuffle
    sent = F.broadcast if pairs <= BROADCAST_IDS else (lambda ids: ids)

    def measured(part: DataFrame) -> DataFrame:
        asked = lambda c: sent(part.select(F.col(c).alias("node")).distinct())
        side = lambda c: nodes.join(asked(c), "node", "left_semi").select(F.col("node").alias(c), F.col("members").alias(f"members_{c}"))
        both = F.size(F.array_intersect("members_x", "members_p"))
        full = part.join(side("x"), "x").join(side("p"), "p").select("x", "p", "n_x", "n_p", both.cast("long").alias("both"))
        union = F.col("n_x") + F.col("n_p") - F.col("both")
        return full.select("x", "p", (100 * F.col("both") >= per_hundred * union).alias("linked"), (1 - F.col("both") / union).alias("d"))

    out = ws.put_each(map(measured, _parts(near, moved or 0, MEASURED * shingles_of_all)), "distances")
    ws.drop(near)
    return out


def _unsettled(members: DataFrame, roots: DataFrame, ws: Workspace) -> DataFrame:
    """(g, x, root) of groups that hold more than one component."""
    rooted = members.join(roots.select(F.col("node").alias("x"), "root"), "x", "left").select("g", "x", F.coalesce("root", "x").alias("root"))
    rooted = ws.put(rooted, "members")
    mark = F.sum(F.xxhash64("x", F.lit(1)).cast("decimal(38,0)"))
    several = rooted.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.min("x").alias("first"), mark.alias("mark")).filter("lo <> hi")
    several = several.groupBy("size", "first", "mark").agg(F.min("g").alias("g")).select("g", "size")
    out = ws.put(rooted.join(several, "g"), "groups")
    ws.drop(rooted)
    return out


def link_groups(members: DataFrame, ws: Workspace, measure: Callable, measure_within: Callable, per_hundred: int = PER_HUNDRED, most: int | None = None, at_once: int = 0) -> DataFrame:
    """Roots (node, root) of the components that the linked pairs inside groups (g, x) make.

    measure(pairs, cap) gives (x, p, linked, d) of the pairs (x, p) within distance cap, or of more; measure_within(groups, r)
    gives it for the pairs of different components within r inside groups (g, x, root) of at most `most` sets, or of any size
    if all groups left together have at most at_once pairs: then no further rounds are needed, whose plans fill the driver.
    """
    most = most or MOST
    r = 1 - per_hundred / 100
    cap = max(CAP, min(1.0, 1.5 * r))  # above r, or pivots would lose links
    by_hash = lambda salt: F.struct(F.xxhash64("x", F.lit(salt)).alias("h"), F.col("x").alias("x"))
    pivots = members.groupBy("g").agg(F.min(by_hash(0)).alias("m")).select("g", F.col("m.x").alias("p"))
    pivoted = members.join(pivots, "g").filter("x <> p")
    links = [measure(pivoted.select("x", "p").distinct(), r).filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))]
    members, depth = pivoted.select("g", "x"), 0
    roots = None
    while True:
        found = links[0] if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        for more in links[1:] if roots is None else links:
            found = found.unionAll(more)
        roots = ws.put(components(found, ws), "roots")
        groups = _unsettled(members, roots, ws)
        sizes, pairs = groups.agg(F.max("size"), F.sum(F.col("size") - 1) / 2).first()
        if sizes is None:
            return roots
        if pairs <= at_once:
            found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            found = found.unionAll(measure_within(groups, r).filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b")))
            return ws.put(components(found, ws), "roots")
        depth += 1
        large = groups.filter(f"size > {LEAF}")
        named = large.groupBy("g").agg(F.min(by_hash(depth)).alias("m")).select("g", F.col("m.x").alias("name"))
        merged = large.join(named, "g").select(F.col("name").alias("g"), "x", "root").distinct()
        merged = merged.join(merged.groupBy("g").agg(F.count("*").alias("size")), "g").select("g", "x", "root", "size")
        groups = ws.put(groups.filter(f"size <= {LEAF}").select("g", "x", "root", "size").unionAll(merged), "merged")
        sizes = groups.agg(F.max("size")).first()[0]
        new = []
        new.append(measure_within(groups.filter(f"size <= {most}"), r))
        if sizes <= most:
            found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            found = found.unionAll(new[0].filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b")))
            return ws.put(components(found, ws), "roots")
        large = groups.filter(f"size > {most}").select("g", "x", "root")
        # members of a group's small components first: once all but one component have been pivots, it is settled
        large = large.join(large.groupBy("g", "root").agg(F.count("*").alias("own")), ["g", "root"]).select("g", "x", "own")
        nth = F.row_number().over(Window.partitionBy("g").orderBy("own", F.xxhash64("x", F.lit(depth)), "x"))
        pivots = ws.put(large.withColumn("k", nth).filter(F.col("k") <= PIVOTS).select("g", F.col("x").alias("p")), "pivots")
        large = large.select("g", "x")
        rest = large.join(pivots.withColumnRenamed("p", "x"), ["g", "x"], "left_anti")
        apart = ws.put(large.join(pivots, "g").filter("x <> p"), "apart")
        measured = measure(apart.select("x", "p").distinct(), cap)
        new.append(measured)
        d = F.least(F.coalesce("d", F.lit(cap)), F.lit(cap))
        placed = rest.join(pivots, "g").join(measured.select("x", "p", "d"), ["x", "p"], "left").select("g", "x", "p", d.alias("d"))
        nearest = placed.groupBy("g", "x").agg(F.min("d").alias("own"), F.collect_list(F.struct("p", "d")).alias("all"))
        eps = 1e-9
        within = F.filter("all", lambda v: (v["d"] < cap) & (v["d"] <= F.col("own") + 2 * r + eps))
        regions = F.concat(F.transform(within, lambda v: v["p"]), F.when(F.col("own") >= cap - r - eps, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")))
        regions = ws.put(nearest.select("g", "x", regions.alias("qs")), "regions")
        wide = regions.groupBy("g").agg((F.sum(F.size("qs")) > SPREAD * F.count("*")).alias("wide"))
        split = F.when(F.col("wide"), F.array(F.lit(-2).cast("long"))).otherwise(F.col("qs"))
        members = regions.join(wide, "g").select("x", F.col("g").alias("g0"), F.explode(split).alias("q")).select(F.xxhash64("g0", "q", F.lit(depth)).alias("g"), "x").distinct()
        links = [n.filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b")) for n in new]


def _classes(docs: DataFrame, k: int, per_hundred: int) -> tuple[DataFrame, DataFrame]:
    """(rows of docs with their sets' marks, name of each class of equal sets: f1, f2, n, component_id, keep_row)."""
    spark = docs.sparkSession
    prepare(spark)
    ws = Workspace(spark)
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("__id"), F.xxhash64(doc_id, text).alias("__key"), text.alias("__text"))
    top = keyed.select("__text").mapInArrow(freed(lambda b: _frequent(b, k)), "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(FREQUENT).toArrow()
    order = Order(top["value"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(np.float64))
    rows = ws.put(keyed.mapInArrow(freed(lambda b: _rows(b, order, k, per_hundred)), ROWS), "rows")
    marks = ["f1", "f2", "n"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"), F.col("row_key").alias("row_key")))
    classes = ws.put(rows.filter("n > 0").groupBy(*marks).agg(first.alias("first")).select(*marks, "first.*"), "classes")
    chosen = classes.select(F.col("row_id").alias("node"))
    # only a class's first row brings its shingles to the groups; it is told before its prefix unfolds
    first_rows = rows.select("row_id", "prefix").join(chosen.withColumnRenamed("node", "row_id"), "row_id", "left_semi")
    # one shuffle serves the counts and the join: both sides read the same columns of it
    spread = first_rows.select(F.explode("prefix").alias("g"), F.col("row_id").alias("x")).repartition("g")
    often = spread.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low < high").select("g")
    members = ws.put(spread.join(often, "g").select("g", "x"), "members")
    slim = ws.put(rows.drop("prefix"), "rows")
    ws.drop(rows)
    rows = slim
    tidy(spark)
    # a family of near copies meets at nearly every shingle of its prefixes; groups of the same members count once
    same = members.groupBy("g").agg(F.count("*").alias("c"), F.min("x").alias("first"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("mark"))
    one = same.groupBy("c", "first", "mark").agg(F.min("g").alias("g")).select("g")
    fewer = ws.put(members.join(one, "g"), "members")
    ws.drop(members)
    members = fewer
    tidy(spark)
    ring = F.floor(F.log("n") / (-math.log(per_hundred / 100) * (1 + 1e-9))).cast("int")
    rings = members.join(classes.select(F.col("row_id").alias("x"), ring.alias("ring")), "x").select("x", "g", F.explode(F.array("ring", F.col("ring") + 1)).alias("ring"))
    rings = rings.select(F.xxhash64("g", "ring").alias("g"), "x")
    often = rings.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g")
    meeting = ws.put(rings.join(often, "g"), "meeting")
    ws.drop(members)
    members = meeting
    tidy(spark)
    wanted = classes.join(members.select(F.col("x").alias("row_id")).distinct(), "row_id").select("doc_id", "row_key", F.col("row_id").alias("node"))
    wanted = ws.put(wanted, "wanted")

    def sets(part: int) -> DataFrame:
        own = lambda c: F.pmod(F.col(c), F.lit(TEXT_PARTS)) == part
        same = (F.col("__key") == F.col("row_key")) & F.col("__id").eqNullSafe(F.col("doc_id"))
        texts = keyed.filter(own("__key")).join(wanted.filter(own("row_key")), same).select("node", "__text")
        return texts.mapInArrow(freed(lambda b: _nodes(b, order, k)), NODES)

    nodes = ws.put_each((sets(part) for part in range(TEXT_PARTS)), "nodes")
    ws.drop(wanted)
    twice = nodes.groupBy("node").count().filter("count > 1").select("node")
    if not twice.isEmpty():  # repeated rows brought them
        once = nodes.join(twice, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "buckets", "members")])
        single = ws.put(nodes.join(twice, "node", "left_anti").unionByName(once), "nodes")
        ws.drop(nodes)
        nodes = single
    tidy(spark)
    in_all = nodes.agg(F.sum("n")).first()[0] or 0
    roots = link_groups(
        members, ws, lambda pairs, cap: _measure(_near(pairs, nodes, cap), nodes, ws, per_hundred, in_all, cap),
        lambda groups, r: _measure(_near_within(groups, nodes, r), nodes, ws, per_hundred, in_all, r), per_hundred,
    )
    ws.drop(nodes, members)
    tidy(spark)
    rooted = classes.join(roots.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("root", F.coalesce("root", "row_id"))
    rooted = ws.put(rooted.select(*marks, "root", "none", "doc_id", "row_id", "row_key"), "rooted")
    named = rooted.groupBy("root").agg(F.min(F.struct("none", "doc_id", "row_id")).alias("least")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.row_id").alias("keep_row"))
    return rows, rooted.join(named, "root").select(*marks, "component_id", "keep_row")


def _rowwise(docs: DataFrame, k: int, per_hundred: int) -> DataFrame:
    rows, classes = _classes(docs, k, per_hundred)
    named = classes.select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.col("n").alias("cn"), "component_id", "keep_row")
    # empty sets are left out of the join: they would all meet at one key
    joined = rows.filter("n > 0").join(named, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
    some = joined.select("doc_id", "row_key", "n", "component_id", (F.col("row_id") == F.col("keep_row")).alias("kept"))
    none = rows.filter("n = 0").select("doc_id", "row_key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionAll(none)


def jaccard_join(docs: DataFrame, k: int = WORDS, per_hundred: int = PER_HUNDRED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    return _rowwise(docs, k, per_hundred).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, k: int = WORDS, per_hundred: int = PER_HUNDRED) -> DataFrame:
    """docs with one row of each component, the one of the smallest doc_id."""
    ws = Workspace(docs.sparkSession)
    found = _rowwise(docs.select("doc_id", "text"), k, per_hundred)
    marks = ws.put(found.groupBy("doc_id", "row_key").agg(F.max("kept").alias("stays"), F.count("*").alias("times")), "marks")
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    # whole rows travel in one column, so that no name of theirs can clash
    rows = docs.select(F.struct("*").alias("row"), doc_id.alias("id"), F.xxhash64(doc_id, text).alias("key"))
    same = (F.col("key") == F.col("row_key")) & F.col("id").eqNullSafe(F.col("doc_id"))
    again = marks.filter("stays and times > 1")
    if again.isEmpty():
        return rows.join(marks.filter("not stays"), same, "left_anti").select("row.*")
    one = rows.join(again, same, "left_semi").groupBy("id", "key").agg(F.first("row").alias("row"))
    return rows.join(marks.filter("not stays or times > 1"), same, "left_anti").select("row").unionByName(one.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))
