"""Filtered k-means against rounds over all distances, in Python's integers."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from strandline.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<double>, tree binary, cluster int"


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    own = collections.Counter()
    for _, d, c in found:
        own[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, c, d, own[c], sum(own.values()), names[c]) for i, d, c in found)


def collected(df):
    return collections.Counter(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, b"", 1) for i, v in rows], SCHEMA)


def families(seed, n, spread=0.05, centres=12):
    r = np.random.default_rng(seed)
    c = r.normal(0, 1, (centres, 64))
    return [(i, (c[r.integers(centres)] + r.normal(0, spread, 64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("tree", [1 << 14, 1100])
def test_clusters_equal_all_distances(spark, monkeypatch, tree):
    monkeypatch.setattr(cc, "TREE", tree)
    rows = families(1, 1500)
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 65), (2003, [float("nan")] + [0.0] * 63), (2004, [float("inf")] * 64), (2005, [None] + [0.0] * 63), (None, [0.25] * 64)]
    rows += [(3000 + i, rows[0][1]) for i in range(700)] + [(5, rows[5][1]), (5, [-0.5] * 64), (6, [-1e-9] * 64), (7, [60000.0] * 64), (8, [-60000.0] * 64)]
    assert collected(cc.cluster(frame(spark, rows))) == brute(rows)


def test_ties_and_few_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 1 / 1024, 2 / 1024]) if j < 3 else 0.0 for j in range(64)]) for i in range(300)]
    assert collected(cc.cluster(frame(spark, rows))) == brute(rows)
    for n in (1, 3):
        assert collected(cc.cluster(frame(spark, rows[:n]))) == brute(rows[:n])
    same = [(i, rows[0][1]) for i in range(200)]
    assert collected(cc.cluster(frame(spark, same))) == brute(same)


def test_empty_table(spark):
    out = cc.cluster(frame(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_trees_prune_and_assign_whole_nodes():
    """The filter does the work: most points of separate families are assigned with their node, none wrongly."""
    points = np.floor(1024 * np.array([v for _, v in families(4, 4000, 0.02, 8)])).astype(np.int64)
    tree = cc.Tree(points, list(range(len(points))))
    centroids = np.stack([points[k] for k in range(0, 4000, 500)])
    whole, to, leaves = tree.filter(centroids)
    direct, _ = cc.resolve(tree.points, centroids)
    assert len(tree.of(whole)) + len(tree.of(leaves)) == len(points)
    assert (np.repeat(to, tree.stop[whole] - tree.first[whole]) == direct[tree.of(whole)]).all()
    assert len(tree.of(whole)) > 0.5 * len(points)


@pytest.mark.parametrize("size", [100, (1 << 26) - 1])
def test_distances_are_exact(size):
    r = np.random.default_rng(7)
    p, c = r.integers(-size, size, (50, 64)), r.integers(-size, size, (5, 64))
    nearest, squared = cc.resolve(p, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for x in p]
    assert list(zip(squared.tolist(), nearest.tolist())) == want


def test_sql_equals_query(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    df = spark.createDataFrame([(i, v) for i, v in families(3, 300)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    own = collected(cc.query(spark, str(tmp_path)))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert collections.Counter(db.execute(cc.SQL).fetchall()) == own
