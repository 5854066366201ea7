"""Exact substring removal over words with a compressed FM-index per shard.

``repeats`` finds where windows can occur again and deals the border runs into
shards.  Each shard is indexed by the Burrows-Wheeler transform of its runs in
a wavelet matrix of packed bits.  The runs then pass as queries: backward
search goes on from each word to the left while more than the word's own
occurrence is left, which gives matching lengths up to the threshold; starts
that reach it and share an interval are equal, and all but the first repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RangeHash, pieces, text_buffer, trimmed, words_of
from .repeats import NULL_ID, Scheme, covers, keyed, with_repeats

WINDOW, GRAM = 20, 5


class WaveletMatrix:
    """Rank queries over a sequence of small integers: one packed bit vector for each bit, highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels, values = bits, [], values.copy()
        for k in range(bits - 1, -1, -1):
            one = (values >> k & 1).astype(bool)
            words = np.zeros(len(one) // 64 + 1, np.uint64)
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words[:-1]).astype(np.int64))))
            zeros = int(len(one) - one.sum())
            self.levels.append((words, before, zeros))
            values = np.concatenate((values[~one], values[one]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & mask)

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``value`` among the first ``i`` values."""
        low = np.zeros(len(i), np.int64)
        for k, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (value >> k & 1).astype(bool)
            a, b = self._ones(words, before, low), self._ones(words, before, i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low


class FMIndex:
    """Backward search over runs, each closed by an end mark.  ``depth`` bounds the length of patterns."""

    def __init__(self, symbols: np.ndarray, off: np.ndarray, depth: int):
        values, ids = np.unique(symbols, return_inverse=True)
        n_runs = len(off) - 1
        self.text = np.zeros(len(symbols) + n_runs, np.int64)  # 0 is the end mark
        run = np.repeat(np.arange(n_runs), np.diff(off))
        self.at = np.arange(len(symbols)) + run
        self.text[self.at] = ids.reshape(-1) + 1
        n, ends = len(self.text), off[1:] + np.arange(n_runs)
        room = np.repeat(ends + 1, np.diff(off) + 1) - np.arange(n)
        rank, step = self.text.copy(), 1
        while step < depth:
            second = np.zeros(n, np.int64)
            if step < n:
                second[: n - step] = np.where(room[: n - step] > step, rank[step:] + 1, 0)
            rank, step = np.unique(rank * np.int64(n + 2) + second, return_inverse=True)[1].reshape(-1), 2 * step
        order = np.argsort(rank, kind="stable")
        bwt = self.text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=len(values) + 1))))
        self.tree = WaveletMatrix(bwt, max(1, int(len(values)).bit_length()))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol`` followed by what the intervals stand for."""
        begin = self.first[symbol]
        return begin + self.tree.rank(symbol, low), begin + self.tree.rank(symbol, high)


def earlier_windows(symbols: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """Positions of the windows of ``window`` symbols, inside runs, that start earlier too."""
    start = np.flatnonzero(np.repeat(off[1:], np.diff(off)) - np.arange(len(symbols)) >= window)
    if not len(start):
        return start
    index = FMIndex(symbols, off, window)
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(index.text), np.int64)
    for k in range(window - 1, -1, -1):
        low, high = index.step(index.text[index.at[start] + k], low, high)
        more = high - low > 1
        start, low, high = start[more], low[more], high[more]
    first = np.unique(low, return_index=True)[1]
    again = np.ones(len(start), bool)
    again[first] = False
    return start[again]


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = words_of(raw, off)
    return RangeHash(raw)(starts, ends), np.searchsorted(row, np.arange(len(off)), "left")


def scheme(window: int = WINDOW, gram: int = GRAM) -> Scheme:
    return Scheme(window, gram, _words, earlier_windows, np.uint32)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the kept words, joined by one space), ``kept_sha256``
    and, if columns ``keep`` are named, those as the struct ``rest`` (``k0``, ``k1``, ..).

    A word goes if a window of ``window`` words over it also starts earlier.
    Ids are integers; a null id sorts first.  Null text has no words.  Rows
    that repeat an id and its text are one document and get the same result;
    rows with one id and different texts are ordered by a hash of the text.
    An empty table gives an empty table.  Further columns are not read.
    """
    if not 0 < gram <= window < 4096:
        raise ValueError("0 < gram <= window < 4096")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, row = words_of(part, at)
                word_off = np.searchsorted(row, np.arange(j - i + 1), "left")
                gone = covers(batch.column(2), word_off, window, slice(i, j))
                starts, ends, row = starts[~gone], ends[~gone], row[~gone]
                kept_off = np.searchsorted(row, np.arange(j - i + 1), "left")
                data = part.tobytes()
                words = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                kept = [b" ".join(words[a:b]) for a, b in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(word_off)), pa.array(np.diff(word_off) - np.diff(kept_off)),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), batch.column(3).slice(i, j - i)],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "rest"],
                )

    long, text = T.LongType(), T.StringType()
    fields = [("doc_id", long), ("n_words", long), ("n_removed", long), ("kept", text), ("kept_sha256", text)]
    out = with_repeats(keyed(docs, id_col, text_col, keep), scheme(window, gram))
    rest = out.schema["rest"]
    out = out.mapInArrow(trimmed(run), T.StructType([*[T.StructField(n, t) for n, t in fields], rest])).withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
    return out if keep else out.drop("rest")
