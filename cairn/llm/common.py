"""Shared pieces of the training-data operators: shared storage, Arrow slicing and vectorised word hashing.

Words are hashed for whole slices of text at once. A word's hash is a polynomial over per-byte random
values modulo 2**64, finished with an avalanche step, so it depends on the word alone and not on where it
stands. Two different words share a hash with a probability of about 5e-20.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by the vectorised code; one longer document is still handled whole.
SLICE_BYTES = 1 << 20
#: Bytes hashed at once inside one slice.
BLOCK_BYTES = 1 << 18

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so Spark's default of 10,000 rows a batch takes tens of MB on both sides; a setting other than the default stays."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local run (tests) makes one; a cluster needs it set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. ``by``: last column, to lay files out by."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove tables made by :func:`materialize` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_cairn_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a small file to the shared folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(data)
    out.close()
    return path


def kth_largest(keys: DataFrame, k: int, bins: int = 1024, few: int = 4096) -> float:
    """The k-th largest of a column ``key``, by histograms over ever smaller ranges; the smallest if there are fewer."""
    if k <= 0:
        return float("inf")
    lo, hi, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    if lo is None:
        return float("inf")
    while True:
        inside = keys.where(F.col("key").between(lo, hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        place = F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / width)).cast("int").alias("bin")
        rows = sorted(inside.groupBy(place).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, n, low, high in rows:
            if above + n >= k:
                lo, hi = low, high
                break
            above += n
        else:
            return lo
        if n <= few:
            values = sorted((r[0] for r in keys.where(F.col("key").between(lo, hi)).select("key").collect()), reverse=True)
            return values[k - above - 1]


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more: it does so when the driver's heap is collected, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def text_views(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of about ``max_bytes``.

    Yields ``(first_row, rows, data, bounds)`` where ``data`` holds the UTF-8 bytes of the range and
    ``bounds`` (rows + 1 entries) the place of each row in it. A null row is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if not rows:
        return
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=column.offset + rows + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept and reused, and would hold on to it between batches."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit avalanche (the finishing step of splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """Splits UTF-8 text into runs of equal byte class and hashes the runs.

    ``classes`` maps each byte value to a class; class 0 separates words, and a word ends where the class
    changes. ``fold`` lower-cases A-Z before hashing.
    """

    def __init__(self, classes: np.ndarray, fold: bool = True):
        self.classes = classes.astype(np.uint8)
        self.simple = int(self.classes.max()) == 1
        values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        if fold:
            values[65:91] = values[97:123]
        self.values = values
        self._powers = self._inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) <= n:
            size = max(n + 1, BLOCK_BYTES + 1)
            with np.errstate(over="ignore"):
                for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                    steps = np.full(size, base, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of every word, in order; words never cross a row's bound."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.classes[data]
        cut = np.empty(len(data) + 1, dtype=bool)
        cut[0] = cut[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        words = kind[starts] > 0
        return starts[words], ends[words]

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64)
        done = 0
        with np.errstate(over="ignore"):
            while done < len(starts):
                low = int(starts[done])
                stop = max(done + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, side="right")))
                high = int(ends[stop - 1])
                self._grow(high - low)
                sums = np.zeros(high - low + 1, dtype=np.uint64)
                np.cumsum(self.values[data[low:high]] * self._powers[: high - low], out=sums[1:])
                s, e = starts[done:stop] - low, ends[done:stop] - low
                out[done:stop] = (sums[e] - sums[s]) * self._inverses[s] + (e - s).astype(np.uint64)
                done = stop
            return mix(out)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes, row bounds in words)."""
        starts, ends = self.spans(data, bounds)
        return starts, ends, self.hashes(data, starts, ends), np.searchsorted(starts, bounds)


def byte_classes(*groups: tuple[int, list[tuple[int, int]]]) -> np.ndarray:
    """Class table from ``(class, [(first, last), ...])``; all other bytes separate."""
    out = np.zeros(256, dtype=np.uint8)
    for cls, ranges in groups:
        for lo, hi in ranges:
            out[lo : hi + 1] = cls
    return out


#: Words are runs of anything but ASCII white space.
NOT_SPACE = byte_classes((1, [(0, 8), (14, 31), (33, 255)]))
#: Words are runs of 0-9, A-Z, a-z and everything outside ASCII.
ALNUM = byte_classes((1, [(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)]))
#: Runs of word characters and runs of punctuation are both words.
WORD_PUNCT = byte_classes((1, [(0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0x80, 0xFF)]), (2, [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x5E), (0x60, 0x60), (0x7B, 0x7E)]))


def binary_rows(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose row i is ``parts[bounds[i]:bounds[i + 1]]`` as bytes."""
    parts = np.ascontiguousarray(parts)
    offsets = (bounds.astype(np.int64) * parts.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(parts)])
