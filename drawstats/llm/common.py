"""Shared pieces: text buffers, word splitting, hashing, storage between jobs.

Python stages read Arrow batches and cut them into pieces of a bounded number
of bytes, so that memory does not depend on the length of the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on (a single longer text makes a longer step).
PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (int(_rng.integers(1, 2**62)) * 4 + 3, int(_rng.integers(1, 2**62)) * 4 + 3)
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back to the system at the end of each partition: workers live on, and the next stage needs theirs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/drawstats-checkpoints"  # one machine, as in tests
    return f"{root.rstrip('/')}/drawstats-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The folder is the session's ``spark.checkpoint.dir``, in it one folder for
    each application (``release`` removes it); only a session on one machine
    may leave it unset.  Shuffle files of the job are let go when it ends:
    whatever comes later reads the files in the folder.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges: no table that grows with the input is collected by the driver, however small it looks."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    _delete(df.sparkSession, _STORED.pop(df))


def release(spark: SparkSession) -> None:
    """Remove everything that this application has stored; results that were not written yet are lost."""
    _delete(spark, _folder(spark))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in ``order``.

    Rows are dealt by ranges of ``order`` and counted in their partition; the
    sizes of the partitions before are added.  ``order`` should end with a
    column that differs in all rows, or equal rows cannot be dealt out.
    """
    ordered = stored(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftrightunsigned("_at", 33))  # ids hold the partition above 33 bits of the row's place in it
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return ordered.join(F.broadcast(before), "_part").select(*df.columns, place.alias(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def words_of(raw: np.ndarray, off: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of concatenated texts, and the row of each word.

    A word is a run of ``solid`` bytes (all but white space, if not given) and
    never runs over the end of a text.
    """
    solid = ~SPACE[raw] if solid is None else solid
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        base = _BASE[which]
        inverse = pow(base, -1, 2**64)
        both = []
        for b in (base, inverse):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done, step = 1, b
            while done < size:
                k = min(done, size - done)
                out[done : done + k] = out[:k] * np.uint64(step)
                done += k
                step = step * step % 2**64
            both.append(out)
        held = both[0], both[1]
        if size <= 4 * PIECE_BYTES:
            _POWERS[which] = held
    return held


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """64-bit hashes of any ranges of a sequence, from one running sum."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        power, self.inverse = _powers(which, len(symbols) + 1)
        value = _BYTE[which][symbols] if symbols.dtype == np.uint8 else symbols * np.uint64(_BASE[1 - which])
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(value * power[: len(symbols)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def union_spans(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Boolean cover of positions 0..n by the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, so that further columns cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
