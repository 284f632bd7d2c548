"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a learned vector of its hash (word input) beside the mean of learned vectors of its four-byte strings,
word ends marked (character input). Two gated recurrent units read a window of WINDOW words from both sides, attention
pools their states, and a logistic unit scores the window. A text's windows overlap by WINDOW - STRIDE words and all are scored; the
text's score is the highest one. Everything is trained in numpy.

Training takes at most SAMPLE_ROWS rows of each label, those of the least doc_id hashes among rows that are not held out;
of a text of more than SAMPLE_POINTS code points one stretch of that length, at a place chosen by the same hash. So a
sample has at most 2 * SAMPLE_ROWS * SAMPLE_POINTS code points, however large the corpus. All weights start at random.
Which window of a toxic text is the toxic one isn't labelled, so rounds go from short texts to long ones (ROUNDS): texts of
one or two windows teach first, and in longer ones the window that the network so far scores highest stands for the
text, beside some random windows of the clean texts.

A null or empty text is one window without words. Without labels of both kinds nothing can be learned and every score is
the share of toxic labels (0 without any). A null doc_id is not held out. Repeated rows are scored alike; extra
columns are left alone.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, distinct, expand, freed, hashed, mix, prepare, read, slices, utf8, words

WINDOW, STRIDE = 12, 8
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN, ATTEND = 1 << 18, 1 << 16, 8, 8, 8
GRAM = 4
SAMPLE_ROWS = 1500
SAMPLE_POINTS = 12_000
HELD_OUT_OF = 5
#: Rounds of training: the most windows of a text, and how often each chosen window is seen.
ROUNDS = ((2, 20), (8, 10), (64, 6), (None, 6), (None, 6), (None, 6))
BATCH, RATE = 96, 0.01
#: Words, and their bytes, whose input is remembered by a worker.
REMEMBERED, REMEMBERED_BYTES = 200_000, 16 << 20
BLOCK = 2048

_BETWEEN = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BETWEEN[_a:_b] = False


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 capitals in UTF-8."""
    out = LOWER[buf]
    second = np.flatnonzero(buf[:-1] == 0xC3) + 1
    second = second[(buf[second] >= 0x80) & (buf[second] <= 0x9E) & (buf[second] != 0x97)]
    out[second] += 0x20
    return out


def grams_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the character table, their number by word): strings of GRAM bytes of each word with its ends marked."""
    size = end - start
    ends = np.cumsum(size + 2)
    at = ends - size - 2
    marked = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    marked[at], marked[ends - 1] = 1, 2
    marked[expand(at + 1, size)] = buf[expand(start, size)]
    count = np.maximum(size + 2 - GRAM + 1, 1)
    first = expand(at, count)
    padded = np.concatenate([marked, np.zeros(GRAM, np.uint8)])
    value = np.zeros(len(first), np.uint64)
    short = np.repeat(size + 2 < GRAM, count)
    for j in range(GRAM):
        byte = padded[first + j]
        if j >= 2:  # only words of one letter are shorter than a string
            byte[short & (first + j >= np.repeat(ends, count))] = 0
        value = value << np.uint64(8) | byte
    return (mix(value) % np.uint64(CHAR_ROWS)).astype(np.int64), count


def inputs_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its rows of the character table, their number by word)."""
    ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
    return hashed(strings), *grams_of(np.frombuffer(b"".join(strings), np.uint8), np.append(0, ends[:-1]), ends)


def window_starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of all windows of rows of n words; every row has one at least."""
    count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), count)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Directions and gates, and what exp() takes: sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 1 - 2 / (1 + exp(2 x)).
_GATES = [d + g for d in "fb" for g in "rzn"]
_SCALE = {"r": -1, "z": -1, "n": 2}


class Network:
    """Weights, and everything done with them."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.w = {"word": normal(WORD_ROWS, DIM, s=0.01), "char": normal(CHAR_ROWS, DIM, s=0.03)}
        for d in "fb":
            self.w |= {f"wx_{d}": normal(2 * DIM, 3 * HIDDEN, s=0.25), f"b_{d}": np.zeros(3 * HIDDEN, np.float32), f"u_{d}": normal(HIDDEN, 3 * HIDDEN, s=0.3)}
        self.w |= {"wa": normal(2 * HIDDEN, ATTEND, s=0.3), "ba": np.zeros(ATTEND, np.float32), "va": normal(ATTEND, s=0.3), "wo": normal(2 * HIDDEN, s=0.3), "bo": np.full(1, -1.0, np.float32)}
        self.m, self.v, self.steps = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0
        self._forget()

    def __getstate__(self):
        return {"w": self.w, "constant": self.__dict__.get("constant")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    constant: float | None = None

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.inputs = {k: np.zeros((1 << 12, HIDDEN), np.float32) for k in _GATES}

    def _project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Gate inputs of word vectors, scaled as the exponentials of _run want them."""
        both = {d: x @ self.w[f"wx_{d}"] + self.w[f"b_{d}"] for d in "fb"}
        return {d + g: both[d][:, k * HIDDEN : (k + 1) * HIDDEN] * np.float32(_SCALE[g]) for d in "fb" for k, g in enumerate("rzn")}

    # --- inputs

    def vectors(self, hashes: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        chars = np.add.reduceat(self.w["char"][grams], at, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.w["word"][(hashes % np.uint64(WORD_ROWS)).astype(np.int64)], chars], axis=1)

    def remembered(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word the row of self.inputs with its gate inputs for both directions; row 0 is no word."""
        if not len(start):
            return np.zeros(0, np.int64)
        strings, back = distinct(buf, start, end)
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget()
        index = np.fromiter((self.known.get(w, 0) for w in strings), np.int64, len(strings))
        new = np.flatnonzero(index == 0)
        if len(new):
            fresh = [strings[k] for k in new.tolist()]
            x = self.vectors(*inputs_of(fresh))
            base = len(self.known) + 1
            while base + len(new) > len(self.inputs["fr"]):
                self.inputs = {k: np.concatenate([t, np.zeros_like(t)]) for k, t in self.inputs.items()}
            for k, t in self._project(x).items():
                self.inputs[k][base : base + len(new)] = t
            index[new] = np.arange(base, base + len(new))
            self.known.update(zip(fresh, range(base, base + len(new)), strict=True))
            self.held += sum(map(len, fresh))
        return index[back]

    # --- scoring

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The highest window score of each row."""
        if self.constant is not None:
            return np.full(len(offs) - 1, self.constant)
        buf = lowered(buf)
        start, end, row = words(buf, offs, _BETWEEN)
        index = np.append(self.remembered(buf, start, end), 0)
        n = np.bincount(row, minlength=len(offs) - 1)
        first = np.cumsum(n) - n
        of, at = window_starts(n)
        out = np.zeros(len(offs) - 1)
        for a in range(0, len(of), BLOCK):
            rows, begin = of[a : a + BLOCK], at[a : a + BLOCK]
            where = begin[None, :] + np.arange(WINDOW)[:, None]
            mask = where < n[rows]
            ids = np.where(mask, index[np.minimum(first[rows] + where, len(index) - 1)], 0)
            np.maximum.at(out, rows, _sigmoid(self._logits(ids, mask)))
        return out

    def _run(self, ids: np.ndarray, mask: np.ndarray, d: str, partial: np.ndarray) -> np.ndarray:
        h = np.zeros((ids.shape[1], HIDDEN), np.float32)
        ur, uz, un = (np.ascontiguousarray(self.w[f"u_{d}"][:, k * HIDDEN : (k + 1) * HIDDEN]) * np.float32(_SCALE[g]) for k, g in enumerate("rzn"))
        tr, tz, tn = (self.inputs[d + g] for g in "rzn")
        out = np.zeros((WINDOW, ids.shape[1], HIDDEN), np.float32)
        one = np.float32(1)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            r = h @ ur
            r += tr[ids[t]]
            np.exp(r, out=r)
            r += one
            new = h @ un
            new /= r
            new += tn[ids[t]]
            np.exp(new, out=new)
            new += one
            np.divide(np.float32(-2), new, out=new)
            new += one
            z = h @ uz
            z += tz[ids[t]]
            np.exp(z, out=z)
            z += one
            step = h - new
            step /= z
            new += step
            h = np.where(mask[t][:, None], new, h) if partial[t] else new
            out[t] = h
        return out

    def _logits(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        partial = ~mask.all(axis=1)
        with np.errstate(over="ignore"):
            h = np.concatenate([self._run(ids, mask, "f", partial), self._run(ids, mask, "b", partial)], axis=2)
        return self._pool(h, mask)[0]

    def _pool(self, h: np.ndarray, mask: np.ndarray):
        with np.errstate(over="ignore"):
            a = 1 - 2 / (1 + np.exp(2 * (h @ self.w["wa"] + self.w["ba"])))
        e = np.where(mask, a @ self.w["va"], -1e9)
        e = np.exp(e - e.max(axis=0)) * mask
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * h).sum(axis=0)
        return pooled @ self.w["wo"] + self.w["bo"], pooled, weight, a

    # --- training

    def gradients(self, words_at: np.ndarray, mask: np.ndarray, y: np.ndarray, table: Words) -> tuple[list[tuple], float]:
        """((weight, rows that the batch used, gradient), mean loss) of windows (WINDOW x batch, rows of table)."""
        distinct, back = np.unique(words_at, return_inverse=True)
        back = back.reshape(words_at.shape)
        hashes, grams, counts = table.of(distinct)
        x = self.vectors(hashes, grams, counts)
        w, g = self.w, {}
        states = {}
        for d in "fb":
            h, kept = np.zeros((len(y), HIDDEN), np.float32), []
            gx_all = x @ w[f"wx_{d}"] + w[f"b_{d}"]
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                gx, gh = gx_all[back[t]], h @ w[f"u_{d}"]
                r, z = _sigmoid(gx[:, :HIDDEN] + gh[:, :HIDDEN]), _sigmoid(gx[:, HIDDEN : 2 * HIDDEN] + gh[:, HIDDEN : 2 * HIDDEN])
                n = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
                m = mask[t][:, None]
                kept.append((t, h, r, z, n, gh[:, 2 * HIDDEN :], m))
                h = np.where(m, (1 - z) * n + z * h, h)
                states[d, t] = h
            states[d] = kept
        h = np.stack([np.concatenate([states["f", t], states["b", t]], axis=1) for t in range(WINDOW)])
        logit, pooled, weight, a = self._pool(h, mask)
        p = _sigmoid(logit)
        dlogit = ((p - y) / len(y)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpooled = dlogit[:, None] * w["wo"]
        dh = weight[:, :, None] * dpooled
        dweight = (h * dpooled).sum(axis=2)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        g["va"] = np.einsum("tb,tbk->k", de, a)
        da = de[:, :, None] * w["va"] * (1 - a * a)
        g["wa"], g["ba"] = np.einsum("tbh,tbk->hk", h, da), da.sum(axis=(0, 1))
        dh += da @ w["wa"].T
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            du, dgx_all, later = np.zeros_like(w[f"u_{d}"]), np.zeros((len(distinct), 3 * HIDDEN), np.float32), np.zeros((len(y), HIDDEN), np.float32)
            for t, before, r, z, n, ghn, m in reversed(states[d]):
                total = dh[t][:, part] + later
                live = total * m
                dz, dn = live * (before - n) * z * (1 - z), live * (1 - z) * (1 - n * n)
                dr = dn * ghn * r * (1 - r)
                dgh = np.concatenate([dr, dz, dn * r], axis=1)
                np.add.at(dgx_all, back[t], np.concatenate([dr, dz, dn], axis=1))
                du += before.T @ dgh
                later = live * z + dgh @ w[f"u_{d}"].T + total * ~m
            g[f"u_{d}"], g[f"wx_{d}"], g[f"b_{d}"] = du, x.T @ dgx_all, dgx_all.sum(axis=0)
            dx += dgx_all @ w[f"wx_{d}"].T
        loss = float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())
        every = slice(None)
        parts = [(k, every, grad) for k, grad in g.items()]
        # of the tables only the rows that the batch used
        for k, of, grad in (("word", (hashes % np.uint64(WORD_ROWS)).astype(np.int64), dx[:, :DIM]), ("char", grams, np.repeat(dx[:, DIM:] / counts[:, None], counts, axis=0))):
            rows, where = np.unique(of, return_inverse=True)
            summed = np.zeros((len(rows), DIM), np.float32)
            np.add.at(summed, where, grad)
            parts.append((k, rows, summed))
        return parts, loss

    def step(self, words_at: np.ndarray, mask: np.ndarray, y: np.ndarray, table: Words) -> float:
        """One Adam step; the loss before it."""
        parts, loss = self.gradients(words_at, mask, y, table)
        self.steps += 1
        rate = np.float32(RATE * (1 - 0.99**self.steps) ** 0.5 / (1 - 0.9**self.steps))
        for k, rows, grad in parts:
            m = self.m[k][rows] * np.float32(0.9) + np.float32(0.1) * grad
            v = self.v[k][rows] * np.float32(0.99) + np.float32(0.01) * grad * grad
            self.m[k][rows], self.v[k][rows] = m, v
            self.w[k][rows] -= rate * m / (np.sqrt(v) + np.float32(1e-7))
        return loss


class Words:
    """The sample's different words with their character strings."""

    def __init__(self, strings: list[bytes]):
        self.hashes, grams, counts = inputs_of(strings)
        self.grams, self.counts = grams.astype(np.int32), counts
        self.at = np.cumsum(self.counts) - self.counts

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.hashes[rows], self.grams[expand(self.at[rows], self.counts[rows])], self.counts[rows]

    def gates(self, net: Network) -> dict[str, np.ndarray]:
        """Gate inputs of all words, block by block."""
        parts = [net._project(net.vectors(*self.of(np.arange(a, min(a + (1 << 14), len(self.hashes)))))) for a in range(0, len(self.hashes), 1 << 14)]
        return {k: np.concatenate([p[k] for p in parts]) for k in _GATES}


class Sample:
    """Texts as rows of a table of their different words, and their windows; four bytes a word, whatever its length."""

    def __init__(self, texts: list[str | None]):
        rows: dict[bytes, int] = {}
        index, counts = [np.zeros(0, np.int32)], []
        for a in range(0, len(texts), 64):
            buf, offs = utf8(pa.array(texts[a : a + 64], pa.large_string()))
            buf = lowered(buf)
            start, end, row = words(buf, offs, _BETWEEN)
            counts.append(np.bincount(row, minlength=len(offs) - 1))
            if len(start):
                strings, own = distinct(buf, start, end)
                index.append(np.array([rows.setdefault(w, len(rows)) for w in strings], np.int32)[own])
        self.index, self.n = np.concatenate(index), np.concatenate(counts)
        self.first = np.cumsum(self.n) - self.n
        self.of, self.at = (x.astype(np.int32) for x in window_starts(self.n))
        self.table = Words(list(rows)) if rows else None

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the table, which of them are words), WINDOW x chosen."""
        where = self.at[chosen][None, :] + np.arange(WINDOW)[:, None]
        mask = where < self.n[self.of[chosen]]
        return np.where(mask, self.index[np.minimum(self.first[self.of[chosen]] + where, len(self.index) - 1)], 0), mask


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Network:
    """A network fitted to texts and their labels (1: toxic)."""
    net, y = Network(seed), np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    sample = Sample(texts)
    if sample.table is None:
        net.constant = float(y.mean())
        return net
    rng = np.random.default_rng(seed)
    of = sample.of
    size = np.bincount(of, minlength=len(y))
    guess = rng.random(len(of)).astype(np.float32)
    for most, epochs in ROUNDS:
        in_round = size[of] <= most if most else np.ones(len(of), bool)
        use = np.flatnonzero(in_round)
        if not len(use) or len(np.unique(y[of[use]])) < 2:
            continue
        order = use[np.lexsort((guess[use], of[use]))]
        best = order[np.append(np.flatnonzero(np.diff(of[order])), len(order) - 1)]
        clean = use[y[of[use]] == 0]
        extra = rng.choice(clean, min(len(clean), len(best)), replace=False)
        chosen = np.concatenate([best, extra])
        target = y[of[chosen]].astype(np.float32)
        for _ in range(epochs):
            shuffled = rng.permutation(len(chosen))
            for a in range(0, len(shuffled), BATCH):
                b = shuffled[a : a + BATCH]
                net.step(*sample.windows(chosen[b]), target[b], sample.table)
        net.inputs = sample.table.gates(net)
        for a in range(0, len(of), BLOCK):
            guess[a : a + BLOCK] = net._logits(*sample.windows(np.arange(a, min(a + BLOCK, len(of)))))
    net._forget()
    return net


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == 0


def _scores(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        for a, b in slices(offs):
            score = net.scores(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            ids = batch.column(0).slice(a, b - a)
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=_OUT)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, points: int = SAMPLE_POINTS) -> Network:
    """Trains in one task from a bounded sample: `rows` rows of each label at most, at most `points` code points of each."""
    prepare(docs.sparkSession)
    id_text = F.col("doc_id").cast("long").cast("string")
    usable = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(id_text) % HELD_OUT_OF != 0)).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    # only rows that docs has; no text is read for that
    usable = usable.join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi")
    pick = lambda v: usable.filter(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(rows)
    # `rows` ids of each label at most: small enough for every executor
    ids = F.broadcast(pick(0).unionAll(pick(1)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length("t") - points + 1, F.lit(1))).cast("int") + 1
    found = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("t")).join(ids, "id").select("id", "y", F.substring("t", place, F.lit(points)).alias("t"))
    sample = found.groupBy("id", "y").agg(F.min("t").alias("t"))
    found = sample.repartition(1).mapInArrow(freed(_trained), "net binary").first()
    return pickle.loads(found[0]) if found else train([], [])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    net = train([t for _, _, t in rows], [y for _, y, _ in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    return _narrow(docs).mapInArrow(freed(lambda b: _scores(b, net)), "doc_id long, held_out boolean, score double, predicted int")


def _clean(batches: Iterator[pa.RecordBatch], net: Network, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = utf8(batch.column(at))
        keep = np.concatenate([np.zeros(0, bool), *(net.scores(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) < 0.5 for a, b in slices(offs))])
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_clean(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    return docs.mapInArrow(freed(lambda b: _clean(b, net, at)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))
