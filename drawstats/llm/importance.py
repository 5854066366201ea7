"""Target-distribution importance resampling on hashed word n-grams, whose checksums are composed and not recomputed.

CRC-32 is linear over GF(2): the checksum of two strings put together is the
first one's, moved on by the length of the second, exclusive-or the second
one's.  Moving on by a length is a 32 x 32 bit matrix.  So the checksum of each
word is computed once, and those of all n-grams come from them; no n-gram is
ever made as a string.  Features fall into buckets by checksum.  Two jobs count
the buckets of the corpus and of the target, one scores all documents, and the
best ones under Gumbel noise keyed by the id are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, numbered, pieces, stored, text_buffer, trimmed, with_columns, words_of

BUCKETS, LONGEST_RUN, LEAST_WORDS, DRAWN_PERCENT, SEED = 10000, 2, 20, 25, 7
POLYNOMIAL = 0xEDB88320
#: Words of at most so many bytes are summed byte by byte for all words at once.
SHORT = 16

#: Bytes of words after lower-casing: digits, small letters, and all of characters beyond ASCII.
SOLID = np.zeros(256, bool)
SOLID[48:58] = SOLID[97:123] = SOLID[128:] = True


def _byte_table() -> np.ndarray:
    """What one byte makes of an empty register."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


_TABLE = _byte_table()


class Shift:
    """The matrix of moving a checksum on by 2 ** k zero bytes, kept as what it makes of each value of each of the four bytes."""

    def __init__(self, columns: np.ndarray):
        self.columns = columns  # what becomes of each bit
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        self.parts = [np.bitwise_xor.reduce(np.where(bits == 1, columns[8 * i : 8 * i + 8], 0).astype(np.uint32), axis=1) for i in range(4)]

    def __call__(self, crc: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return a[crc & 255] ^ b[(crc >> 8) & 255] ^ c[(crc >> 16) & 255] ^ d[crc >> 24]

    def twice(self) -> Shift:
        return Shift(self(self.columns))


def _one_byte() -> Shift:
    bit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return Shift((bit >> np.uint32(8)) ^ _TABLE[bit & 255])


_SHIFTS = [_one_byte()]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums moved on by ``length`` bytes each: one matrix for each binary digit of a length."""
    out, k = crc.astype(np.uint32), 0
    while len(length) and int(length.max()) >> k:
        if k == len(_SHIFTS):
            _SHIFTS.append(_SHIFTS[-1].twice())
        on = (length >> k) & 1 == 1
        out[on] = _SHIFTS[k](out[on])
        k += 1
    return out


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of strings put together, from theirs and the ``length`` of the second ones."""
    return shifted(first, length) ^ second


def word_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each range of bytes."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for k in range(min(SHORT, int(size.max(initial=0)))):
        on = np.flatnonzero((size > k) & (size <= SHORT))
        out[on] = (out[on] >> np.uint32(8)) ^ _TABLE[(out[on] ^ raw[starts[on] + k]) & 255]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    return out


def buckets(raw: np.ndarray, off: np.ndarray, longest: int = LONGEST_RUN, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to ``longest`` words, joined by one space, and the words of each row."""
    lower = LOWER[raw]
    starts, ends, row = words_of(lower, off, SOLID[lower])
    size, word = ends - starts, word_sums(lower, starts, ends)
    rows, sums, run = [row], [word], word
    space = np.full(len(word), zlib.crc32(b" "), np.uint32)
    spaced = joined(space, word, size)  # a space and the word
    for n in range(2, longest + 1):
        if len(row) < n:
            break
        run = joined(run[:-1], spaced[n - 1 :], size[n - 1 :] + 1)  # at each word, the run of n words that begins there
        whole = row[n - 1 :] == row[: 1 - n]
        rows.append(row[: 1 - n][whole])
        sums.append(run[whole])
    return np.concatenate(rows), (np.concatenate(sums) % np.uint32(n_buckets)).astype(np.int64), np.bincount(row, minlength=len(off) - 1)


def bucket_counts(texts: DataFrame, text_col: str, longest: int, n_buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks send counts, and the driver gets ``n_buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            for i, j in pieces(off):
                total += np.bincount(buckets(raw[off[i] : off[j]], off[i : j + 1] - off[i], longest, n_buckets)[1], minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    got = with_columns(texts, text_col).mapInArrow(trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket speaks for the target: thousandths of the log ratio of smoothed shares, rounded down."""
    n = len(corpus)
    above = (target + 1.0) * float(corpus.sum() + n)
    below = (corpus + 1.0) * float(target.sum() + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """``id_col``, ``n_words``, ``n_features`` and ``weight``, the mean gain of a text's features, rounded down (none: 0)."""
    n_buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                row, bucket, n_words = buckets(raw[off[i] : off[j]], off[i : j + 1] - off[i], longest, n_buckets)
                n = np.bincount(row, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, row, gain[bucket])
                arrays = [pa.array(x.astype(np.int64)) for x in (n_words, n, total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *arrays], names=["id", "n_words", "n_features", "weight"])

    out = with_columns(docs, id_col, text_col)
    return out.mapInArrow(trimmed(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> F.Column:
    """Gumbel noise in thousandths, rounded down, from the digest of seed and id (null as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST_RUN, n_buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn).

    Of the documents with at least ``least_words`` words ``percent`` in a
    hundred (rounded down) are drawn, by score, ties by the smaller id, then by
    number of features and weight.  Null text has no words, weight 0; null ids
    come first and have the noise of an empty id; repeated rows each count in
    the corpus and have ranks of their own.  An empty target leaves only the
    corpus to judge by; an empty table gives an empty one; other columns are
    not read.
    """
    gain = gains(bucket_counts(docs, text_col, longest, n_buckets), bucket_counts(target, target_col, longest, n_buckets))
    rows = stored(weighed(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise(id_col, seed)).withColumn("_row", F.monotonically_increasing_id()))
    fit = rows.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc(f"`{id_col}`"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    ranked = numbered(fit, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(f"`{id_col}`", "n_features", "weight", "score", "rank")
