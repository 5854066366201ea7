"""Exact substring removal over bytes with longest-previous-factor arrays.

``repeats`` finds where windows can occur again and deals the border runs into
shards.  In each shard this module sorts all suffixes, computes the common
prefixes of neighbours in suffix order, and takes for each suffix the previous
and the next one in that order with a smaller position: the longer of the two
common prefixes is its longest previous factor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, text_buffer, trimmed
from .repeats import NULL_ID, Scheme, covers, keyed, with_repeats

WINDOW, GRAM = 100, 32
#: Symbols in the first sort key: nine bits each, so that the end of a run sorts before byte 0.
_FIRST, _BITS = 7, 9


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def suffix_order(symbols: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """Suffixes in the order of at least their first ``depth`` symbols (ties by position), the room each has to the
    end of its run, ranks by depth, and the first sort keys."""
    n = len(symbols)
    room = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(_FIRST):
        value = np.zeros(n, np.int64)
        if k < n:
            value[: n - k] = symbols[k:].astype(np.int64) + 1
        key = key << _BITS | np.where(room > k, value, 0)
    rank, step, ranks = _dense(key), _FIRST, []
    while True:
        ranks.append((step, rank))
        if step >= depth:
            return np.argsort(rank, kind="stable"), room, ranks, key
        second = np.zeros(n, np.int64)
        if step < n:
            second[: n - step] = np.where(room[: n - step] > step, rank[step:] + 1, 0)
        rank, step = _dense(rank * np.int64(n + 1) + second), 2 * step


def common_prefixes(order: np.ndarray, room: np.ndarray, ranks: list[tuple[int, np.ndarray]], key: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in suffix order (0 for the first), as far as the ranks reach."""
    n = len(order)
    a, b = order[:-1], order[1:]
    most = np.minimum(room[a], room[b])
    length = np.zeros(len(a), np.int64)
    for step, rank in reversed(ranks):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length[(length < most) & (rank[x] == rank[y])] += step
    x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
    differ = key[x] ^ key[y]
    for k in range(1, _FIRST):
        length += (length < most) & (differ >> (_BITS * (_FIRST - k)) == 0)
    return np.concatenate(([0], np.minimum(length, most)))


def _before(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each entry with the nearest earlier entry of the order that has a smaller position (0 if none).

    All entries look back at once; each step jumps over what the entry looked at has already jumped over.
    """
    at, low = np.arange(len(order)) - 1, lcp.copy()
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[order[at[open_]] > order[open_]]
        there = at[open_]
        to, through = at[there], low[there]
        low[open_] = np.minimum(low[open_], through)
        at[open_] = to
        open_ = open_[to >= 0]
    low[at < 0] = 0
    return low


def longest_previous_factors(symbols: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """For each position the longest match, inside runs, that starts earlier; exact up to ``depth`` symbols."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    order, room, ranks, key = suffix_order(symbols, off, depth)
    lcp = common_prefixes(order, room, ranks, key)
    back = _before(order, lcp)
    ahead = np.concatenate(([0], lcp[1:][::-1]))
    ahead = _before(order[::-1], ahead)[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(back, ahead)
    return out


def _index(symbols: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    return np.flatnonzero(longest_previous_factors(symbols, off, window) >= window)


def _bytes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw, off


def scheme(window: int = WINDOW, gram: int = GRAM) -> Scheme:
    return Scheme(window, gram, _bytes, _index, np.uint8)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) and ``kept_sha256``.

    A byte goes if a string of ``window`` bytes over it also starts earlier.
    Ids are integers; a null id sorts first.  Null text is empty.  Rows that
    repeat an id and its text are one document and get the same result; rows
    with one id and different texts are ordered by a hash of the text.  An
    empty table gives an empty table.  Further columns are not read.
    """
    if not 0 < gram <= window < 4096:
        raise ValueError("0 < gram <= window < 4096")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                gone = covers(batch.column(2), at, window, slice(i, j))
                edge = np.zeros(len(gone) + 1, bool)
                edge[1:-1] = gone[:-1]
                edge[at] = False
                opened = gone & ~edge[:-1]
                kept_at = np.concatenate(([0], np.cumsum(~gone)))[at]
                data = part[~gone].tobytes()
                kept = [data[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
                spans = np.concatenate(([0], np.cumsum(opened)))[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(x) for x in (np.diff(at), np.diff(at) - np.diff(kept_at), np.diff(spans))),
                     pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    long, text = T.LongType(), T.StringType()
    fields = [("doc_id", long), ("n_bytes", long), ("n_removed", long), ("n_spans", long), ("kept", T.BinaryType()), ("kept_sha256", text)]
    out = with_repeats(keyed(docs, id_col, text_col), scheme(window, gram)).select("d", "text", "spans")
    out = out.mapInArrow(trimmed(run), T.StructType([T.StructField(n, t) for n, t in fields]))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
