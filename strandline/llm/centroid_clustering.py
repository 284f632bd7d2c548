"""k-means in exact integers by kd-tree filtering.

Vectors become integers, floor(scale * component), and are dealt out evenly; each task builds kd-trees of at most TREE of
them, whose nodes hold a count, componentwise integer sums and a bounding box, and writes them to the shared folder once.
A round sends the centroids to every tree. From the root down, a node keeps the centroids that may be nearest to a point
of its box: one is pruned if the corner that favours it most is still strictly nearer to the centroid nearest to the
box's middle, so ties are never pruned. A node left with one centroid is assigned as a whole, by its sums; leaves
left with several are resolved point by point. Levels of a tree are taken in one vectorised step. What leaves a task is a
count and a sum for each centroid and component; the driver sees k * size of them, whatever the number of vectors.

Vectors of another length, null ones, and those with null or non-finite components are left out, as are those with a
component of 2^16 or more in magnitude: their squared distances need not fit a long. Without any vector the result is
empty; with fewer than k there are fewer centroids. Rows with equal ids are vectors of their own; equal starting hashes
are ordered by the vector, null ids start nothing unless others are too few. A centroid that no vector is nearest to stays
where it is. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, expand, freed, prepare, read, shuffle_width

#: Vectors of one tree.
TREE = 1 << 14
#: Points of a leaf at most, unless all are equal.
LEAF = 32
#: Components of this magnitude and more are out of range, before scaling.
RANGE = 1 << 16
#: Integers up to this keep all sums of a distance exact in double precision, up to 4,096 components.
_EXACT = 1 << 19


class Tree:
    """Points in the order of the leaves; nodes level by level, the two children of a node side by side."""

    def __init__(self, points: np.ndarray, ids: list):
        n = len(points)
        order = np.arange(n)
        first, stop, child, low, high = [0], [n], [], [], []
        at = 0
        while at < len(first):
            lo, hi = first[at], stop[at]
            own = points[order[lo:hi]]
            low.append(own.min(0))
            high.append(own.max(0))
            width = high[-1] - low[-1]
            if hi - lo <= LEAF or not width.any():
                child.append(-1)
            else:
                middle = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, int(width.argmax())], middle)]
                child.append(len(first))
                first += [lo, lo + middle]
                stop += [lo + middle, hi]
            at += 1
        self.points, self.ids = points[order], [ids[i] for i in order.tolist()]
        self.first, self.stop, self.child = (np.array(x, np.int64) for x in (first, stop, child))
        self.low, self.high = np.stack(low), np.stack(high)
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        self.sums = total[self.stop] - total[self.first]

    def filter(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes assigned as a whole, the centroid of each, leaves to be resolved)."""
        whole, to, open_leaves = [], [], []
        nodes, near = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            apart = 2 * centroids - (low + high)[:, None, :]
            middle = np.where(near, (apart * apart).sum(2), np.iinfo(np.int64).max)
            best = centroids[middle.argmin(1)][:, None, :]
            corner = np.where(centroids > best, high[:, None, :], low[:, None, :])
            near &= ((centroids - best) * (centroids + best - 2 * corner)).sum(2) <= 0  # |c - corner|^2 - |best - corner|^2
            single = near.sum(1) == 1
            whole.append(nodes[single])
            to.append(near[single].argmax(1))
            leaf = self.child[nodes] < 0
            open_leaves.append(nodes[leaf & ~single])
            down = ~single & ~leaf
            nodes, near = np.stack([self.child[nodes[down]], self.child[nodes[down]] + 1], 1).ravel(), np.repeat(near[down], 2, axis=0)
        return np.concatenate(whole), np.concatenate(to), np.concatenate(open_leaves)

    def of(self, nodes: np.ndarray) -> np.ndarray:
        return expand(self.first[nodes], self.stop[nodes] - self.first[nodes])

    def moments(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, componentwise sums) of the points nearest to each centroid."""
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, to, leaves = self.filter(centroids)
        np.add.at(n, to, self.stop[whole] - self.first[whole])
        np.add.at(sums, to, self.sums[whole])
        points = self.points[self.of(leaves)]
        nearest, _ = resolve(points, centroids)
        for c in range(len(centroids)):
            own = nearest == c
            n[c] += own.sum()
            sums[c] += points[own].sum(0)
        return n, sums

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, squared distance) of every point."""
        cluster, distance = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        whole, to, leaves = self.filter(centroids)
        at = self.of(whole)
        cluster[at] = np.repeat(to, self.stop[whole] - self.first[whole])
        apart = self.points[at] - centroids[cluster[at]]
        distance[at] = (apart * apart).sum(1)
        at = self.of(leaves)
        cluster[at], distance[at] = resolve(self.points[at], centroids)
        return cluster, distance


def resolve(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, the smallest number of equals; squared distance) of every point, by all distances."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(np.abs(points).max(), np.abs(centroids).max()) <= _EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        squared = ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        squared = np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)
    nearest = squared.argmin(1)
    return nearest, squared[np.arange(len(points)), nearest]


def _plant(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held, ids = [], []

    def tree() -> pa.RecordBatch:
        grown = Tree(np.concatenate(held), ids)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grown, protocol=5)], pa.large_binary())], names=["tree"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part.column(1).flatten().to_numpy().reshape(-1, size))
            ids += part.column(0).to_pylist()
            if len(ids) + 1024 > TREE:
                yield tree()
                held, ids = [], []
    if ids:
        yield tree()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for blob in batch.column(0):
            yield pickle.loads(blob.as_py())


def _moments(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cluster, dim, n, total) of a task's vectors."""
    k, size = centroids.shape
    n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for tree in _trees(batches):
        own_n, own = tree.moments(centroids)
        n, sums = n + own_n, sums + own
    columns = [np.repeat(np.arange(k), size), np.tile(np.arange(size), k), np.repeat(n, size), sums.ravel()]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "dim", "n", "total"])


def _inertia(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cluster, total) of each tree."""
    for tree in _trees(batches):
        cluster, distance = tree.assign(centroids)
        totals = [sum(distance[cluster == c].tolist()) for c in range(len(centroids))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int64()), pa.array(totals, pa.decimal128(38, 0))], names=["cluster", "total"])


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _members(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, inertia: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    name, own = pa.array(names), pa.array(inertia, pa.int64())
    for tree in _trees(batches):
        cluster, distance = tree.assign(centroids)
        columns = [pa.array(tree.ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance), own.take(pa.array(cluster)), pa.repeat(pa.scalar(sum(inertia), pa.int64()), len(cluster)), name.take(pa.array(cluster))]
        rows = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])
        yield from (rows.slice(at, 4096) for at in range(0, rows.num_rows, 4096))


def integers(rows: DataFrame, size: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, x: array<long>) of the vectors that take part: where they lie, and dealt out evenly."""
    fit = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < RANGE, F.lit(False)))
    kept = rows.filter((F.size("embedding") == size) & fit).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    whole = [F.col("vec_id"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x")]
    return kept.select(*whole), kept.repartition(shuffle_width(rows.sparkSession)).select(*whole)


def starts(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors of the smallest hashes, in their order."""
    named = vectors.withColumn("hash", F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256))
    return np.array([r["x"] for r in named.orderBy(F.asc_nulls_last("hash"), "x").limit(k).collect()], np.int64)


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, prefix: str = "3:") -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = rows.sparkSession
    prepare(spark)
    ws = Workspace(spark)
    lying, dealt = integers(rows, size, scale)
    centroids = starts(lying, k, prefix)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    trees = ws.put(dealt.mapInArrow(freed(lambda b: _plant(b, size)), "tree binary"), "trees")
    for _ in range(rounds):
        at = centroids
        parts = trees.mapInArrow(freed(lambda b, c=at: _moments(b, c)), "cluster long, dim long, n long, total long")
        totals = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).filter("n > 0").collect()
        centroids = centroids.copy()
        for r in totals:
            centroids[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    sums = trees.mapInArrow(freed(lambda b: _inertia(b, centroids)), "cluster long, total decimal(38,0)").groupBy("cluster").agg(F.sum("total").alias("total")).collect()
    inertia = [0] * len(centroids)
    for r in sums:
        inertia[r["cluster"]] = int(r["total"])
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return trees.mapInArrow(freed(lambda b: _members(b, centroids, inertia, names)), _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def _sql(k: int, rounds: int, size: int, scale: int, prefix: str) -> str:
    """The rounds unrolled, one row for each vector and component."""
    out = f"""
with kept as materialized (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda v: floor({scale} * v::double)::bigint) as x
    from embeddings
    where len(embedding) = {size} and len(list_filter(embedding, lambda v: v is not null and isfinite(v::double) and abs(v::double) < {RANGE})) = {size}),
points as materialized (select r, unnest(x) as v, unnest(range({size})) as i from kept),
c0 as materialized (
    select c, unnest(x) as v, unnest(range({size})) as i
    from (select row_number() over (order by sha256('{prefix}' || vec_id) nulls last, x) - 1 as c, x from kept) where c < {k})"""
    for n in range(rounds + 1):
        out += f""",
a{n} as materialized (
    select r, min(struct_pack(d := d, c := c)) as m
    from (select p.r, q.c, sum((p.v - q.v) * (p.v - q.v)) as d from points p join c{n} q using (i) group by p.r, q.c) group by r)"""
        if n < rounds:
            out += f""",
s{n} as materialized (select m.c as c, i, sum(v) as s, count(*) as n from points join a{n} using (r) group by m.c, i),
c{n + 1} as materialized (
    select q.c, coalesce((s - ((s % n) + n) % n) // n, q.v)::bigint as v, q.i from c{n} q left join s{n} t on q.c = t.c and q.i = t.i)"""
    return out + f""",
names as (select c, sha256(string_agg(v::varchar, ',' order by i)) as name from c{rounds} group by c)
select vec_id, m.c::int as cluster, m.d::bigint as distance, (sum(m.d) over (partition by m.c))::bigint as cluster_inertia,
    (sum(m.d) over ())::bigint as inertia, name as centroid_sha256
from kept join a{rounds} using (r) join names on names.c = m.c"""


SQL = _sql(8, 10, 64, 1024, "3:")
