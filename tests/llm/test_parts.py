"""Sets and lines that are sent part by part give what all at once gives."""

import random

import numpy as np

from strandline.llm import common, jaccard_join, line_dedup
from strandline.llm.common import Workspace


def _families(seed, families, copies, words, edits):
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = [f"w{rng.randrange(900)}" for _ in range(words)]
        for k in range(copies):
            w = list(base)
            for at in rng.sample(range(0, words, 6), k % edits):
                w[at] = f"w{rng.randrange(900)}"
            texts.append(" ".join(w))
    return texts


def test_jaccard_pairs_are_measured_in_parts(spark, monkeypatch):
    """The sets that travel for one part's pairs hold about a share of all shingles, and no link is lost between parts."""
    texts = _families(3, 2, 5, 60, 5)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = []
    whole = Workspace.put_each
    monkeypatch.setattr(jaccard_join, "MEASURED", 0.2)
    monkeypatch.setattr(Workspace, "put_each", lambda self, of, name: whole(self, (of := list(of), parts.append((name, len(of))))[0], name))
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(table, 3, 80).collect()}
    assert {n for name, n in parts if name == "nodes"} == {jaccard_join.TEXT_PARTS}
    assert max(n for name, n in parts if name == "distances") >= 2
    sets = [set(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert got == set(enumerate(root))


def test_sets_of_lines_are_built_once_a_pair(spark):
    """A filter on measured pairs reads what was written; it used to move below the sets, which were then built for each use."""
    ws = Workspace(spark)
    texts = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghij!"), (3, "abcdez")], "node long, line string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "x long, p long")
    got = line_dedup.distances(pairs, texts, ws).filter("linked")
    assert [(r.x, r.p, round(r.d, 6)) for r in got.collect()] == [(1, 2, round(1 / 7, 6))]
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_long_sets_are_parted_before_they_travel(spark):
    """Bucket counts of long sets are all alike; pairs of them used to be measured by their complete sets."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 50, 6000)
    sets = [base, np.concatenate([base[:5700], rng.integers(0, 1 << 50, 300)]), np.concatenate([base[:5400], rng.integers(0, 1 << 50, 600)]), *[rng.integers(0, 1 << 50, 6000) for _ in range(3)]]
    rows = [(k, len(s), np.bincount(s % jaccard_join.BUCKETS, minlength=jaccard_join.BUCKETS).tolist(), s.tolist()) for k, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, jaccard_join.NODES)
    ws = common.Workspace(spark)
    pairs = spark.createDataFrame([(x, p) for x in range(6) for p in range(x + 1, 6)], "x long, p long")
    near = ws.put(jaccard_join._near(pairs, nodes, 0.2), "near")
    assert near.count() == 15
    left = {(r.x, r.p) for r in jaccard_join._nearer(near, nodes, ws, 0.2, 20000.0).collect()}
    assert {(0, 1), (0, 2)} <= left <= {(0, 1), (0, 2), (1, 2)}
