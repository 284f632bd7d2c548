"""Exact dedup by Grace hashing.

Records are partitioned by a content hash into spill files, recursively and with a new hash at each level, until a
bucket's distinct contents fit an open-addressing table that compares complete contents. Each input task first does
this for its own rows, so a text that fills a third of the corpus leaves each task once; Spark's shuffle by hash is
then the outermost partitioning of what is left, and the same table finishes every partition.

Rows are equal when their texts agree after deleting ASCII white space. Of equal rows the one with the most code
points in its original text stays, then the smallest doc_id (null last), then the first read. A null text counts as
empty, all empty texts are one group, a repeated row is a row of its own, and extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITESPACE, Workspace, freed, prepare, read, shuffle_width, unused

#: Bytes of distinct content that one table may hold before it spills.
TABLE_BYTES = 96 << 20
FANOUT = 16
#: Levels of rehashing; a bucket that is still too large then holds hash-identical contents and stays in one table.
MAX_LEVEL = 8


class Group:
    """One distinct content: its best row so far, how many rows it has, and who asked for it."""

    __slots__ = ("content", "best", "payload", "size", "tags", "hash", "key")

    def __init__(self, key, content, hashed, best, payload):
        self.key, self.content, self.hash, self.best, self.payload, self.size, self.tags = key, content, hashed, best, payload, 0, []


class GraceTable:
    """Open addressing over distinct contents; beyond `budget` bytes all records go to spill files by hash."""

    def __init__(self, budget: int = TABLE_BYTES, level: int = 0, keys: Iterator[int] | None = None, seen: Callable | None = None):
        self.budget, self.level, self.keys, self.seen = budget, level, keys, seen
        self.slots, self.groups, self.held, self.files = [-1] * 1024, [], 0, None

    def add(self, content: bytes, best: tuple, payload=None, size: int = 1, tag=None, note=None) -> None:
        """best: the smallest wins. tag: kept with the group. note: handed to `seen` with the group's key."""
        if self.files is None and self.held > self.budget and self.level < MAX_LEVEL:
            self._spill()
        hashed = xxhash.xxh3_64_intdigest(content, seed=self.level)
        if self.files is not None:
            pickle.dump((content, best, payload, size, [] if tag is None else [tag], [] if note is None else [note], None), self.files[hashed % FANOUT])
            return
        group = self._find(content, hashed, best, payload)
        self._update(group, best, payload, size)
        if tag is not None:
            group.tags.append(tag)
        if note is not None:
            self.seen(group.key, note)

    def _find(self, content: bytes, hashed: int, best: tuple, payload, key: int | None = None) -> Group:
        slots, mask = self.slots, len(self.slots) - 1
        at = hashed & mask
        while (k := slots[at]) >= 0:
            group = self.groups[k]
            if group.hash == hashed and group.content == content:
                return group
            at = (at + 1) & mask
        slots[at] = len(self.groups)
        group = Group((next(self.keys) if self.keys else 0) if key is None else key, content, hashed, best, payload)
        self.groups.append(group)
        self.held += len(content) + (len(payload) if isinstance(payload, bytes) else 0) + 300
        if 2 * len(self.groups) > len(slots):
            self._grow()
        return group

    @staticmethod
    def _update(group: Group, best: tuple, payload, size: int) -> None:
        group.size += size
        if best < group.best:
            group.best, group.payload = best, payload

    def _grow(self) -> None:
        self.slots = slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for k, group in enumerate(self.groups):
            at = group.hash & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k

    def _spill(self) -> None:
        """What the table holds moves to the files as well, with the keys already given out."""
        self.files = [tempfile.TemporaryFile() for _ in range(FANOUT)]
        for g in self.groups:
            pickle.dump((g.content, g.best, g.payload, g.size, g.tags, [], g.key), self.files[g.hash % FANOUT])
        self.slots, self.groups, self.held = [-1] * 1024, [], 0

    def finish(self) -> Iterator[Group]:
        if self.files is None:
            yield from self.groups
            return
        for file in self.files:
            file.seek(0)
            inner = GraceTable(self.budget, self.level + 1, self.keys, self.seen)
            while True:
                try:
                    inner._again(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from inner.finish()

    def _again(self, content, best, payload, size, tags, notes, key) -> None:
        if self.files is None and self.held > self.budget and self.level < MAX_LEVEL:
            self._spill()
        hashed = xxhash.xxh3_64_intdigest(content, seed=self.level)
        if self.files is not None:
            pickle.dump((content, best, payload, size, tags, notes, key), self.files[hashed % FANOUT])
            return
        group = self._find(content, hashed, best, payload, key)
        self._update(group, best, payload, size)
        group.tags.extend(tags)
        for note in notes:
            self.seen(group.key, note)


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITESPACE)


def rank(text: str | None, doc_id: int | None, row: int) -> tuple:
    """The smallest stays: most code points, smallest doc_id, first row."""
    return (-len(text or ""), doc_id is None, doc_id or 0, row)


def _within_tasks(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: each input row with its task's group. Rows of kind 1: each of the task's groups."""
    first = TaskContext.get().partitionId() << 36
    notes: list[tuple] = []
    keys = iter(range(first, first + (1 << 36)))
    table = GraceTable(budget, 0, keys, lambda key, note: notes.append((key, *note)))
    row = first

    def members() -> pa.RecordBatch:
        cols = list(zip(*notes, strict=True))
        notes.clear()
        return _local_batch(0, cols[0], cols[1], cols[2], len(cols[0]))

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table.add(normalise(text), rank(text, doc_id, row), None, 1, None, (row, doc_id))
            row += 1
        if len(notes) >= 4096:
            yield members()
    for g in _chunks(table.finish(), 1 << 22):
        if notes:
            yield members()
        yield _local_batch(
            1, [x.key for x in g], [x.best[3] for x in g], [None if x.best[1] else x.best[2] for x in g], len(g),
            [x.content.decode("utf-8", "surrogatepass") for x in g], [-x.best[0] for x in g], [x.size for x in g],
        )
    if notes:
        yield members()


LOCAL = "kind int, task_group long, row_id long, doc_id long, content string, n_points long, n_rows long, hash long"
_LOCAL = pa.schema([("kind", pa.int32()), ("task_group", pa.int64()), ("row_id", pa.int64()), ("doc_id", pa.int64()), ("content", pa.string()), ("n_points", pa.int64()), ("n_rows", pa.int64()), ("hash", pa.int64())])


def _local_batch(kind, keys, rows, ids, n, contents=None, points=None, sizes=None) -> pa.RecordBatch:
    none = [None] * n
    hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed=99) - 2**63 for x in contents] if contents else none
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(([kind] * n, keys, rows, ids, contents or none, points or none, sizes or none, hashes), _LOCAL, strict=True)], schema=_LOCAL)


def _chunks(groups: Iterator[Group], most: int) -> Iterator[list[Group]]:
    out, held = [], 0
    for g in groups:
        out.append(g)
        held += len(g.content) + 100
        if held > most:
            yield out
            out, held = [], 0
    if out:
        yield out


MERGED = "task_group long, keep_id long, keep_row long, group_size long, text_sha256 string"
_MERGED = pa.schema([("task_group", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _across_tasks(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """One row for each task's group: who stays, of how many."""
    table = GraceTable(budget)
    for batch in batches:
        for key, row, doc_id, content, points, size in zip(*(batch.column(n).to_pylist() for n in ("task_group", "row_id", "doc_id", "content", "n_points", "n_rows")), strict=True):
            table.add(content.encode("utf-8", "surrogatepass"), (-points, doc_id is None, doc_id or 0, row), None, size, key)
    for part in _chunks(table.finish(), 1 << 22):
        out = [(tag, None if g.best[1] else g.best[2], g.best[3], g.size, digest) for g in part for digest in [hashlib.sha256(g.content).hexdigest()] for tag in g.tags]
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _MERGED, strict=True)], schema=_MERGED)


def exact_dedup(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    ws = Workspace(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = ws.put(narrow.mapInArrow(freed(lambda b: _within_tasks(b, budget)), LOCAL), "task-groups")
    reps = local.filter("kind = 1").select("task_group", "row_id", "doc_id", "content", "n_points", "n_rows", "hash")
    merged = reps.repartition(shuffle_width(spark), "hash").mapInArrow(freed(lambda b: _across_tasks(b, budget)), MERGED)
    rows = local.filter("kind = 0").select("task_group", "row_id", "doc_id")
    return rows.join(merged, "task_group").select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")


def _best_rows(batches: Iterator[pa.RecordBatch], budget: int, local: bool, marks: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """The row that stays of each content, with all its columns; locally with the hash and rank to merge by."""
    row = TaskContext.get().partitionId() << 36
    table, schema = GraceTable(budget), None
    for batch in batches:
        schema = batch.schema
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = dict(zip(schema.names, values, strict=True))
            text = at["text"]
            table.add(normalise(text), rank(text, at["doc_id"], row if local else values[-1]), pickle.dumps(values))
            row += 1
    for part in _chunks(table.finish(), 1 << 22):
        rows = [pickle.loads(g.payload) for g in part]
        columns = [pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)]
        if local:
            columns += [pa.array([xxhash.xxh3_64_intdigest(g.content, seed=99) - 2**63 for g in part], pa.int64()), pa.array([g.best[3] for g in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, *marks])
        else:
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).select(schema.names[:-2])


def keep_distinct(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    spark = docs.sparkSession
    prepare(spark)
    marks = unused(docs, "hash"), unused(docs, "row")
    wide = T.StructType([*docs.schema.fields, *[T.StructField(m, T.LongType()) for m in marks]])
    local = docs.mapInArrow(freed(lambda b: _best_rows(b, budget, True, marks)), wide)
    return local.repartition(shuffle_width(spark), marks[0]).mapInArrow(freed(lambda b: _best_rows(b, budget, False, marks)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), r AS (
  SELECT doc_id, n,
         row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS nth,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(n) AS text_sha256 FROM r
"""
