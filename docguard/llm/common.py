"""What the text operators share: tables, hand-offs between jobs, hashing of bytes in numpy."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docguard.session import new_path, removed, small_batches  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

#: A side is broadcast only if it has at most so many rows (each of a few dozen bytes).
BROADCAST_ROWS = 100_000

#: The separators of words in SQL and as bytes.
BLANKS = "[\\\\x20\\\\x09-\\\\x0D]+"
BLANK_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Handoff:
    """Written tables in the shared folder; drop() removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, step: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{step}")
        df.write.parquet(path)
        self.paths[step] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *steps: str) -> None:
        removed(self.spark, *(self.paths.pop(s) for s in steps or list(self.paths)))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if a count proves that it is small; else as it is, for a shuffled join."""
    rows = min(rows, BROADCAST_ROWS)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits of 64-bit values (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


#: Powers that a worker keeps between tasks; longer runs are made for one call.
KEPT_POWERS = 1 << 20


def _powers(n: int, base: int, name: str) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, grown by doubling; at most KEPT_POWERS of them stay in the worker."""
    have = _POWERS.get(name, np.ones(1, np.uint64))
    while len(have) <= n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _POWERS[name] = have if len(have) <= KEPT_POWERS else have[:KEPT_POWERS].copy()
    return have


def released() -> None:
    """Give back what this process holds without use: the powers kept, and freed memory that its allocators keep for later."""
    import pyarrow as pa

    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries may have none
    if trim is not None:
        trim(0)


def tidy(run: Callable, forget: Callable[[], None] = released) -> Callable:
    """A function for mapInArrow or applyInArrow after which, at the end of a task or group, its worker forgets what it kept.

    Workers live on from task to task and through all stages of a session. Else each of them holds the most that any stage
    left in it, beside what the present one needs.
    """
    if inspect.isgeneratorfunction(run):
        @functools.wraps(run)
        def tidied(batches):
            try:
                yield from run(batches)
            finally:
                forget()
    else:
        @functools.wraps(run)
        def tidied(table):
            try:
                return run(table)
            finally:
                forget()
    return tidied


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash of a byte buffer, and the powers that bring a slice to position 0."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _powers(n, _BASE, "up")[:n], out=sums[1:])
    return sums, _powers(n, pow(_BASE, -1, 1 << 64), "down")


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of a byte buffer."""
    sums, down = rolling(data)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary array; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray | None = None):
    """Starts, ends and row numbers of the maximal runs of bytes that are no separators, within rows."""
    if blank is None:
        blank = np.zeros(256, bool)
        blank[np.frombuffer(BLANK_BYTES, np.uint8)] = True
    inside = ~blank[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def slabs(batches, size: int = 1 << 20):
    """Cut Arrow batches by bytes, so that working arrays stay within the cache and memory."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
