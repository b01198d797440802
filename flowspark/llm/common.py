"""What the operators share: the shared folder for intermediate tables, and words and rolling hashes of Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All hashes are 64-bit, computed with numpy
over whole batches; a document is never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
#: Bytes that are hashed at once; their powers stay in memory.
HASH_BYTES = 1 << 18
BATCH_ROWS, BATCH_BYTES = 2500, "16MB"
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
_own_folders: dict[str, str] = {}
#: Folders of tables that ``materialize`` wrote.
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xD1342543DE82EF95 | 1


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folders.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="flowspark-")
        _own_folders[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this is open, the session's Arrow batches are bounded for rows with whole texts; then they are as before.

    Spark reads these settings when a job starts, so that the job must be run inside. Smaller settings of the session stay.
    """
    conf, before = spark.conf, {k: spark.conf.get(k, None) for k in _BATCHES}
    rows, size = _BATCHES
    if int(conf.get(rows)) > BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    if before[size] in (None, str((1 << 31) - 1), "2147483647b"):
        conf.set(size, BATCH_BYTES)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Written in small Arrow batches; the session's own settings are left as they were.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _written[written] = path
    return written


def discard(df: DataFrame) -> None:
    """Remove a table made by ``materialize`` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(_written.pop(df))
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hashed_sample(df: DataFrame, rows: int, key: str, *others: str) -> DataFrame:
    """At most ``rows`` rows of distinct ``key``, the first by its hash, whatever the partitions.

    Hashes are thinned out by the number of keys first, so that little more than ``rows`` are sorted.
    """
    have = df.groupBy(key).agg(*[F.min(c).alias(c) for c in others])
    share = min(1.0, (2 * rows + 2000) / max(1, have.count()))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return have.where(place < int(share * (1 << 30))).orderBy(place, key).limit(rows)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """B**i, or its inverse, modulo 2**64 for i < n."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        factors = np.full(max(n, HASH_BYTES + 1), base, np.uint64)
        factors[0] = 1
        _powers[kind] = have = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


class Words:
    """Words of consecutive documents.

    ``data``: all texts, each ended by a line feed; ``start``/``end``: byte offsets of each word; ``doc``: index of
    its document; ``first``: index of the first word of each document (length n + 1); ``ends``: offset of the
    line feed of each document. ``outside``: for each byte, whether it parts words; a line feed must.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, outside: np.ndarray = _SPACE):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        joined = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary())) if len(texts) else texts
        buffers, n, at = joined.buffers(), len(joined), joined.offset
        offsets = np.frombuffer(buffers[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if n and buffers[2] is not None else np.zeros(0, np.uint8)
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (upper.view(np.uint8) << 5)
        self.ends = offsets[1:] - offsets[0] - 1
        self.begins = offsets[:-1] - offsets[0]
        inside = ~outside[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.append(self.begins, len(self.data)))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial. Spans are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + HASH_BYTES)))
        a, b = start[lo], end[hi - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[a:b]] * _power("up", b - a), out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        h = (sums[e] - sums[s]) * _power("down", b - a + 1)[s]
        out[lo:hi] = mix64(h ^ ((e - s).astype(np.uint64) * np.uint64(_WINDOW_BASE)))
        lo = hi
    return out


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` values, by doubling: as many as len(h) - width + 1."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    total, length, power, base = None, 0, h.copy(), _WINDOW_BASE
    step, bits = 1, width
    while bits:
        if bits & 1:
            if total is None:
                total, length = power.copy(), step
            else:
                n = len(h) - length - step + 1
                total = total[:n] + power[length : length + n] * np.uint64(pow(_WINDOW_BASE, length, 1 << 64))
                length += step
        bits >>= 1
        if bits:
            power = power[:-step] + power[step:] * np.uint64(base)
            base = base * base & _MASK
            step *= 2
    return mix64(total)


def doc_windows(words: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window that lies within one document."""
    hashes = window_hashes(h, width)
    at = np.flatnonzero(words.doc[: len(hashes)] == words.doc[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[at], at


def tidy(encoders: bool = True) -> None:
    """Give freed memory back to the system at the end of a task: Python workers live on between stages.

    ``encoders``: drop what tasks that encode text keep for each other.
    """
    tokens = sys.modules.get("flowspark.llm.tokens")
    if encoders and tokens is not None:
        tokens.shared.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES, encoders: bool = True) -> Iterator[pa.RecordBatch]:
    """Slices with about ``most`` bytes of text each, one document at least; texts stay whole."""
    if encoders:
        tidy()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes + 1) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    tidy(encoders)
