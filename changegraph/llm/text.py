"""Shared helpers: words and window hashes of whole Arrow batches, shared storage.

A *word* is a maximal run of characters other than space and U+0009..U+000D. Texts are
never cut: helpers work on whole documents, a few megabytes of documents at a time.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 2 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# A fixed odd multiplier and its inverse modulo 2**64, for prefix sums of polynomial hashes.
_M = 0x9E3779B97F4A7C15
_MI = pow(_M, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}
try:  # glibc keeps freed memory unless it is told to trim
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = None


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        with np.errstate(over="ignore"):
            have = np.full(size, base, dtype=np.uint64)
            have[0] = 1
            np.cumprod(have, out=have)
        _pow[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_STEP = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring values, by its first position."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        acc = h[:n] * _STEP[0]
        for k in range(1, width):
            acc += h[k : n + k] * _STEP[k]
    return mix64(acc)


class Chunk:
    """Whole documents of one Arrow array: bytes, document bounds and words."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.first, self.bounds = first, bounds
        self.data = _LOWER[data] if lower else data
        self.n = len(bounds) - 1
        inside = ~_WS[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        starts_of_docs = bounds[:-1][bounds[:-1] < bounds[1:]]
        before[starts_of_docs] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[starts_of_docs[1:] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        #: the words of document i are word_bounds[i] .. word_bounds[i + 1]
        self.word_bounds = np.searchsorted(self.starts, bounds)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per document, how many bytes are flagged."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges (empty ranges allowed)."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_M, n), out=total[1:])
            h = (total[ends] - total[starts]) * _powers(_MI, n + 1)[starts]
            return mix64(h + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def word_docs(self) -> np.ndarray:
        """The document (from 0 in this chunk) of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.word_bounds))

    def window_ok(self, width: int) -> np.ndarray:
        """Which windows lie inside one document, by first word (one flag a window)."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        end = np.repeat(self.word_bounds[1:], np.diff(self.word_bounds))
        return np.arange(n) + width <= end[:n]

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = CHUNK_BYTES):
    """Slices of a string column (null: empty text) of about ``size`` bytes, never cutting a text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1)
        j = min(j, len(column))
        yield Chunk(i, data[bounds[i] : bounds[j]], (bounds[i : j + 1] - bounds[i]).astype(np.int64), lower)
        i = j


def words(text: Column | str) -> Column:
    """Array of the words of a text; null text: no words."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORD_SPLIT), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def in_remainder(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; a null id is in no remainder."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: What other modules remember in a worker and forget when it turns to other work.
caches: list[dict] = []


def release() -> None:
    """At the end of a task: forget what only other work needs, and give freed memory back to the machine."""
    for cache in caches:
        cache.clear()
    for base, have in list(_pow.items()):
        if len(have) > 2 * CHUNK_BYTES:
            del _pow[base]
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing (tests, local mode) a local folder is made."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.getConf().get("spark.master", "local").startswith("local"):
            root = "file://" + os.path.join(tempfile.gettempdir(), "changegraph-shared")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write as Parquet to shared storage and read that again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def n_groups(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
