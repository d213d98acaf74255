"""Shared pieces of the corpus operators: staging, skew-proof lookups, byte-level word kernels.

The kernels work on Arrow buffers with numpy, a few megabytes at a time, so a
Python worker's memory depends on the longest single text and not on the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys are broadcast by skew_lookup: those that hold over 1/HEAVY of all rows each.
HEAVY = 1000
#: Bytes of text that one kernel call works on.
SLICE = 2 << 20


# ---------------------------------------------------------------- staging


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tempora-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def skew_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of rows to table on keys, safe against hot keys.

    table holds one row per key; its column `weight` is at least the number of
    rows with that key. Keys heavier than 1/HEAVY of all rows, of which there
    are at most HEAVY, are told by their hashes and joined by broadcast; the
    rest by shuffle, where no key is heavy any more. Both inputs should be staged.
    """
    floor = max(rows.count() / HEAVY, 64)
    mark = F.xxhash64(*keys)
    marks = [r.mark for r in table.where(F.col(weight) > floor).select(mark.alias("mark")).collect()]  # at most HEAVY
    if not marks:
        return rows.join(table, keys)
    heavy = mark.isin(marks)
    hot = rows.where(heavy).join(F.broadcast(table.where(heavy)), keys)
    return hot.unionByName(rows.where(~heavy).join(table.where(~heavy), keys))


# ---------------------------------------------------------------- kernels

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the result."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers; the same everywhere for a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_BASE = [int(x) for x in constants(77, 2)]
_INVERSE = [pow(b, -1, 1 << 64) for b in _BASE]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd base and of its inverse modulo 2^64, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 1)
        out = []
        for b in (_BASE[which], _INVERSE[which]):
            x = np.full(size, b, dtype=U64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[which] = (out[0], out[1])
    return have


def release() -> None:
    """Gives back memory that earlier operators left in this worker: the powers, and what the allocators hold."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def fold_ascii() -> np.ndarray:
    """Byte -> byte, A-Z to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


FOLD = fold_ascii()
_TABLE = constants(5, 256)[FOLD]
#: Word bytes: everything but blank space (space and 09-0D).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes: ASCII letters and digits, and every byte of a code point over 7F.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blob_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of about limit bytes: (first row, last row + 1, bytes, offsets)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a run of texts: byte starts and ends, and first[d]..first[d+1] are the words of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        inside = table[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:n]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of every word, A-Z read as a-z."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, U64)
        p, q = powers(n + 1, which)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, dtype=U64)
            total[0] = 0
            np.cumsum(_TABLE[self.data] * p[:n], out=total[1:])
            h = (total[self.end] - total[self.start]) * q[self.start]
            return mix(h + (self.end - self.start).astype(U64))


def runs(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each k consecutive entries, from every start that has k."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    c = constants(seed, k)
    with np.errstate(over="ignore"):
        h = words[:m] * c[0]
        for j in range(1, k):
            h += words[j : j + m] * c[j]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as int64 with the same bits, for Spark's long."""
    return x.view(np.int64)


def rows_of(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def digest_spans(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """kind:start:end joined by commas, by start and then by kind as listed."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
