"""Shared plumbing: tables in the shared folder, Arrow batch access, vectorised text hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..functions.shipping import ship

#: ASCII white space, the separators of every word rule here (fixed values).
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows in one Arrow batch; keeps a batch of long texts far below a worker's memory.
BATCH_ROWS = 512
#: Bytes of one such batch, where this Spark can bound them.
BATCH_BYTES = 8 << 20
#: Text bytes handled by one vectorised step.
CHUNK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WHITESPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors and bounds the Arrow batches that they hand to Python."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="strandline-")
        shared_dir.own = found
    return found.rstrip("/")


class Workspace:
    """Tables written once to the shared folder, so that a lost executor never costs more than a reread."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/strandline/{uuid.uuid4().hex}"
        # the driver keeps the text of each of many plans for its listeners
        spark.conf.set("spark.sql.maxPlanStringLength", "4096")

    def put(self, df: DataFrame, name: str | None = None) -> DataFrame:
        path = f"{self.root}/{name or 't'}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strandline_path = path
        # plans and generated classes of what is written pile up on the driver, its shuffle files on the executors
        self.spark.sparkContext._jvm.System.gc()
        return out

    def put_each(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """One table of parts of one schema, written one after another: only one part's shuffle files are there at a time."""
        path, schema = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}", None
        for df in parts:
            df.write.mode("append").parquet(path)
            schema = schema or df.schema
            tidy(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        out._strandline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(t._strandline_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what has been written; together they may be larger than the input. Its cleaner
    works on collected references, beside the driver's thread, so it is given a moment."""
    for _ in range(2):
        release()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def freed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """f for mapInArrow, releasing memory when a worker's task ends: workers serve later tasks of quite other stages, beside
    a heap that has grown by then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; one longer row is a range of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(different byte strings, which of them each span is); spans come in order and don't overlap."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
    coded = spans.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def hashed(strings: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span."""
    strings, index = distinct(buf, start, end)
    return hashed(strings)[index]


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of k bytes (8 or more), by start: two overlapping halves, mixed at every doubling."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    width = 8
    h = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(buf), 8).copy().view("<u8").ravel()
    while width < k:
        step = min(width, k - width)
        h = mix(h[:-step] * _ODD[0] + h[step:] + _ODD[1])
        width += step
    return mix(h)


def words(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run without white space (or other bytes between words); runs end at row ends."""
    space = between[buf]
    begins = ~space
    begins[1:] &= space[:-1]
    edges = offs[(offs > 0) & (offs < len(buf))]
    begins[edges] = ~space[edges]
    start = np.flatnonzero(begins)
    stops = np.zeros(len(buf) + 1, bool)
    stops[1:-1] = space[1:] & ~space[:-1]
    if len(buf):
        stops[-1] = not space[-1]
    stops[edges] = ~space[edges - 1]
    end = np.flatnonzero(stops)
    row = np.searchsorted(offs, start, "right") - 1
    return start, end, row


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 for every i, in order."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    if not len(lengths):
        return np.zeros(0, np.int64)
    at = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    out[at[0]] = starts[0]
    out[at[1:]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)
