"""Shared pieces of the training-data operators.

* ``stored``: cut lineage with a Parquet table in the folder that the cluster shares
  (``spark.checkpoint.dir``); Spark's own commit protocol makes it safe under retries.
* vectorised word hashing: an Arrow string column is seen as one byte buffer, words are
  found with a byte-class table and told apart by their bytes; Python code runs once per
  distinct word, which gets an xxh3 hash.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh3_64_intdigest

#: Bytes of text that one vectorised step handles; a longer document is one step by itself.
SLICE_BYTES = 2 << 20
#: Rows of one Arrow batch sent to Python; texts are long, so fewer than Spark's default.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Session settings all operators rely on: small Arrow batches keep Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, set here only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="duelspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return what reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(frame: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes not to clash with a column (in any case) of ``frame``."""
    held = {c.lower() for c in frame.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def width(spark: SparkSession) -> int:
    """Partitions a keyed shuffle goes to; the cluster sizes it with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_seen = 0
_give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim(every: int = 16) -> None:
    """Now and then hand freed memory back to the system: workers live on after a task."""
    global _seen
    _seen += 1
    if _seen % every == 0:
        pa.default_memory_pool().release_unused()
        if _give_back is not None:
            _give_back(0)


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls (null: empty) and without an offset, in one piece."""
    trim()
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(column.type):
        return pa.array([""] * len(column), pa.string())
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if column.offset:
        column = pa.concat_arrays([column, pa.array([], pa.string())])
        if column.offset:
            column = pa.array(column.to_pylist(), pa.string())
    return column


def spans(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with at most ``most`` bytes (or one row)."""
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, n + 1).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept, and grown by doubling."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        made = []
        for x in (base, inverse):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        held = _powers[base] = (made[0], made[1])
    return held[0][:n], held[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    symbol = np.zeros(256, bool)  # bytes of a word of digits, a-z and all beyond ASCII
    symbol[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return space, lower, symbol


IS_SPACE, LOWER, IS_SYMBOL = _tables()


class Words:
    """Words of consecutive texts: start and end byte, and of each text the first word's number."""

    __slots__ = ("start", "end", "bounds", "data")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        ok = np.zeros(len(data) + 2, bool)
        if len(data):
            ok[1:-1] = ~IS_SPACE[data] if inside is None else inside[data]
        left, right = ok[1:-1] & ~ok[:-2], ok[1:-1] & ~ok[2:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]  # words don't run from one text into the next
        if len(cut):
            both = cut[ok[cut] & ok[cut + 1]]
            left[both] = True
            right[both - 1] = True
        self.data = data
        self.start = np.flatnonzero(left)
        self.end = np.flatnonzero(right) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def distinct(self, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, compared by their bytes (A-Z lower-cased if asked), and of each word its number among them."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.start] += 1
        edge[self.end] -= 1
        body = self.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        ends = np.zeros(len(self.start) + 1, np.int32)
        np.cumsum(self.end - self.start, out=ends[1:])
        packed = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[body] if lower else body)])
        encoded = packed.dictionary_encode()
        return encoded.dictionary, encoded.indices.to_numpy()

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes (A-Z lower-cased if asked): xxh3, once per distinct word."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        words, number = self.distinct(lower)
        return np.fromiter(map(xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[number]


def windows(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each k consecutive entries; entry i belongs to hashes[i : i + k]."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers(n + 1, base)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])
