"""Where a window of symbols occurs again: distribution and bookkeeping for exact substring removal.

A window of ``window`` symbols is a repeat if the same symbols also start
earlier (smaller document, or the same document and an earlier start).  This
module finds all repeats of a corpus without a row for every position:

1. Each window names an anchor, the leftmost of its ``gram``-symbol parts with
   the smallest hash.  Equal windows have equal anchors at equal distances, so
   only occurrences of one anchor hash need to be compared.  Neighbouring
   windows share anchors; one row holds a run of windows and a hash of the run.
2. Rows meet by anchor hash, sorted, and pass as a stream.  A run equal to an
   earlier run repeats in whole.  Runs whose anchor has other surroundings
   elsewhere are borders; all others occur once and are dropped.
3. The symbols of border runs meet by anchor hash in shards of bounded size,
   where an index (given by the caller) tells which windows occur earlier.
   Anchors with more than ``HOT`` surroundings are compared window by window
   instead, each window by its own 128-bit hash, so no shard holds them.

Copies inside one piece of input are settled there, before any shuffle, so a
text with very many copies sends one row per piece and not one per copy.
Nothing is sampled or capped and no set grows with the corpus on any machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RangeHash, mixed, partitions, pieces, stored, text_buffer, trimmed

#: Distinct surroundings of an anchor from which its windows are compared one by one.
HOT = 4096
#: Symbols of border runs in one shard (a single anchor may exceed it, up to HOT runs).
SHARD_SYMBOLS = 1 << 19
#: For an id that is null: it sorts before all others.
NULL_ID = -(1 << 63)
#: What a document is known by.
_WHO = ["d", "v", "u"]
_LOW = np.int64((1 << 32) - 1)

#: From the bytes of texts: symbols and the offsets of the texts in them.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: From concatenated runs in order and their offsets: which positions start a window that starts earlier too.
Index = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Scheme:
    window: int
    gram: int
    symbols: Symbols
    index: Index
    #: The type in which a border run's symbols travel.
    packed: type
    hot: int = HOT
    shard_symbols: int = SHARD_SYMBOLS


def _first_at(grams: np.ndarray, q: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """For each ``q`` the first position in ``[q, q + width)`` with the hash ``value``."""
    out = np.empty(len(q), np.int64)
    step = max(1, (1 << 20) // width)
    for i in range(0, len(q), step):
        at = q[i : i + step, None] + np.arange(width)
        out[i : i + step] = q[i : i + step] + (grams[at] == value[i : i + step, None]).argmax(1)
    return out


def anchor_runs(symbols: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs ``q1..q2`` of window starts with one anchor ``a``, and the anchor's hash ``h``; windows stay inside texts."""
    n, width = len(symbols), window - gram + 1
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    at = np.arange(n - gram + 1)
    grams = RangeHash(symbols)(at, at + gram)
    low, size = grams, 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(off[1:] - window + 1, off[:-1]), 1)
    np.add.at(change, off[1:], -1)
    ok = (np.cumsum(change)[: len(low)]) == 0
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
    last = np.ones(len(low), bool)
    last[:-1] = new[1:] | ~ok[1:]
    q1, q2 = np.flatnonzero(ok & new), np.flatnonzero(ok & last)
    a = _first_at(grams, q1, low[q1], width)
    late = a < q2  # the smallest hash occurs again in the run: its later windows have later anchors
    if late.any():
        count = (q2 - a)[late]
        q = np.repeat(a[late] + 1, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        own = _first_at(grams, q, low[q], width)
        fresh = np.ones(len(q), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (q[1:] != q[:-1] + 1)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(q)) - 1
        q1, q2, a = np.concatenate((q1, q[begin])), np.concatenate((np.minimum(q2, a), q[end])), np.concatenate((a, own[begin]))
    return q1, q2, a, grams[a]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows begin another key."""
    fresh = np.ones(len(keys[0]), bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return fresh


def _merged(d: np.ndarray, v: np.ndarray, u: np.ndarray, q1: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one document that touch, put together."""
    order = np.lexsort((q1, u, v, d))
    d, v, u, q1, q2 = (x[order] for x in (d, v, u, q1, q2))
    if not len(d):
        return d, v, u, q1, q2
    fresh = _groups(d, v, u)
    fresh[1:] |= q1[1:] > q2[:-1] + 1
    begin = np.flatnonzero(fresh)
    return d[begin], v[begin], u[begin], q1[begin], np.maximum.reduceat(q2, begin)


def _differ(*pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.logical_or.reduce([a != b for a, b in pairs])


_DUP, _BORDER, _HOT = 0, 1, 2
_ANCHOR = T.StructType(
    [T.StructField(n, t) for n, t in (("h", T.LongType()), ("c", T.LongType()), ("kind", T.ByteType()), ("d", T.LongType()), ("v", T.LongType()), ("u", T.LongType()), ("loc", T.LongType()))]
)


def _spread(d: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A key for settled rows, which need not meet: it deals them out evenly."""
    return mixed((d * 31 + v + q).view(np.uint64)).view(np.int64)


def _rows(schema: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema)


def _find(scheme: Scheme) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw, off = text_buffer(batch.column(3))
            for i, j in pieces(off):
                symbols, at = scheme.symbols(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                q1, q2, a, h = anchor_runs(symbols, at, scheme.window, scheme.gram)
                if not len(q1):
                    continue
                c = RangeHash(symbols, 1)(q1, q2 + scheme.window)
                row = np.searchsorted(at, q1, "right") - 1
                # rows in the order of their identity: one number stands for the three
                who = np.lexsort((ties[1][i:j], ties[0][i:j], ids[i:j]))
                place = np.empty(j - i, np.int64)
                place[who] = np.cumsum(_groups(ids[i:j][who], ties[0][i:j][who], ties[1][i:j][who]))
                place, base = place[row], at[row]
                q1, q2, a = q1 - base, q2 - base, a - base
                order = np.lexsort((a, place, c, h))
                h, c, row, place, q1, q2, a = (x[order] for x in (h, c, row, place, q1, q2, a))
                d, v, u = (x[i:j][row] for x in (ids, *ties))
                one = _groups(h, c)
                lead = np.flatnonzero(one)[np.cumsum(one) - 1]
                again = ~one & _differ((place, place[lead]), (a, a[lead]))
                yield _rows(
                    _ANCHOR.names, h[one].view(np.int64), c[one].view(np.int64), np.full(one.sum(), _BORDER, np.int8), d[one], v[one], u[one], (a << 24 | (a - q1) << 12 | (a - q2))[one]
                )
                d, v, u, q1, q2 = _merged(*(x[again] for x in (d, v, u, q1, q2)))
                yield _rows(_ANCHOR.names, _spread(d, v, q1), np.zeros(len(d), np.int64), np.full(len(d), _DUP, np.int8), d, v, u, q1 << 32 | q2)

    return run


_FOUND = T.StructType([f for f in _ANCHOR if f.name != "c"])


def _sorted_out(limit: int) -> Callable:
    """From rows in the order of (h, c, d, v, u, loc): repeats, borders and hot borders.  Holds at most ``limit`` rows between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "d", "v", "u", "loc"]
        held = [np.zeros(0, np.int64) for _ in names]  # first rows of the last group
        hot: int | None = None  # the last group's hash, if it is hot and only its last row is held

        def out(kind: int, which: np.ndarray, h: np.ndarray, d: np.ndarray, v: np.ndarray, u: np.ndarray, loc: np.ndarray) -> pa.RecordBatch:
            h, d, v, u, loc = (x[which] for x in (h, d, v, u, loc))
            return _rows(_FOUND.names, h, np.full(len(h), kind, np.int8), d, v, u, loc)

        def spans(loc: np.ndarray) -> np.ndarray:
            a = loc >> 24
            return (a - (loc >> 12 & 4095)) << 32 | (a - (loc & 4095))

        for batch in batches:
            kind = batch.column(2).to_numpy()
            h, c, d, v, u, loc = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names)
            done = kind == _DUP
            if done.any():
                yield out(_DUP, done, h, d, v, u, loc)
                h, c, d, v, u, loc = (x[~done] for x in (h, c, d, v, u, loc))
            if not len(h):
                continue
            n_held = len(held[0])
            h, c, d, v, u, loc = (np.concatenate((a, b)) for a, b in zip(held, (h, c, d, v, u, loc), strict=True))
            first = _groups(h, c)
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            again = ~first & _differ(*((x, x[lead]) for x in (d, v, u, loc)))
            yield out(_DUP, again, h, d, v, u, spans(loc))
            was_held = (np.arange(len(h)) < n_held)[first]
            h, c, d, v, u, loc = (x[first] for x in (h, c, d, v, u, loc))
            begin = np.flatnonzero(_groups(h))
            size = np.diff(np.append(begin, len(h)))
            group = np.repeat(np.arange(len(begin)), size)
            is_hot = size > limit
            if hot is not None and h[0] == hot:
                is_hot[0] = True
            last = group == len(begin) - 1
            told = ~last & ~is_hot[group] & (size[group] > 1)
            yield out(_BORDER, told, h, d, v, u, loc)
            fresh = is_hot[group] & ~(was_held & (hot is not None) & (h == (hot if hot is not None else 0)))
            yield out(_HOT, fresh, h, d, v, u, loc)
            hot = int(h[-1]) if is_hot[-1] else None
            held = [x[-1:] if hot is not None else x[last] for x in (h, c, d, v, u, loc)]
        if hot is None and len(held[0]) > 1:
            yield out(_BORDER, np.ones(len(held[0]), bool), held[0], *held[2:])

    return run


_RUN = T.StructType([*[f for f in _ANCHOR if f.name not in ("loc",)], T.StructField("q", T.LongType()), T.StructField("run", T.BinaryType())])


def _borders(scheme: Scheme) -> Callable:
    """From texts and their borders: symbols of border runs, windows of hot ones, windows settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw, off = text_buffer(batch.column(3))
            lists = batch.column(4)
            cut, told = lists.offsets.to_numpy(), lists.flatten()
            first = int(cut[0])
            kind, loc, h = (told.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            cut = cut - first
            for i, j in pieces(off):
                symbols, at = scheme.symbols(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                s = slice(cut[i], cut[j])
                row = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
                a = loc[s] >> 24
                q1, q2 = a - (loc[s] >> 12 & 4095), a - (loc[s] & 4095)
                hot = kind[s] == _HOT
                cold = np.flatnonzero(~hot)
                small = symbols.astype(scheme.packed)
                data = [small[x:y].tobytes() for x, y in zip((at[row] + q1)[cold].tolist(), (at[row] + q2 + scheme.window)[cold].tolist(), strict=True)]
                d, v, u = (x[i:j][row] for x in (ids, *ties))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h[s][cold], np.zeros(len(cold), np.int64), np.full(len(cold), _BORDER, np.int8), d[cold], v[cold], u[cold], q1[cold])] + [pa.array(data, pa.binary())],
                    names=_RUN.names,
                )
                if hot.any():
                    yield from _hot_windows(scheme, symbols, at[row][hot], d[hot], v[hot], u[hot], q1[hot], q2[hot])

    return run


def _hot_windows(scheme: Scheme, symbols: np.ndarray, base: np.ndarray, d: np.ndarray, v: np.ndarray, u: np.ndarray, q1: np.ndarray, q2: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each distinct window, its first in this piece; the others repeat."""
    count = q2 - q1 + 1
    who = np.repeat(np.arange(len(q1)), count)
    q = q1[who] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = base[who] + q
    w1, w2 = RangeHash(symbols)(start, start + scheme.window), RangeHash(symbols, 1)(start, start + scheme.window)
    d, v, u = d[who], v[who], u[who]
    order = np.lexsort((q, u, v, d, w2, w1))
    w1, w2, d, v, u, q = (x[order] for x in (w1, w2, d, v, u, q))
    first = _groups(w1, w2)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = ~first & _differ(*((x, x[lead]) for x in (d, v, u, q)))
    none = lambda n: pa.nulls(n, pa.binary())
    n = int(first.sum())
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1[first].view(np.int64), w2[first].view(np.int64), np.full(n, _HOT, np.int8), d[first], v[first], u[first], q[first])] + [none(n)], names=_RUN.names)
    d, v, u, q1, q2 = _merged(*(x[again] for x in (d, v, u, q, q)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_spread(d, v, q1), np.zeros(len(d), np.int64), np.full(len(d), _DUP, np.int8), d, v, u, q1 << 32 | q2)] + [none(len(d))], names=_RUN.names)


_MARK = T.StructType([T.StructField(n, T.LongType()) for n in ("d", "v", "u", "span")])


def _shards(scheme: Scheme) -> Callable:
    """From rows in the order of (h, c, d, v, u, q): the windows that occur earlier, as spans of starts."""

    def marks(d: np.ndarray, v: np.ndarray, u: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        d, v, u, q1, q2 = _merged(d, v, u, q, q)
        return _rows(_MARK.names, d, v, u, q1 << 32 | q2)

    def indexed(shard: list[tuple]) -> pa.RecordBatch:
        d, v, u, q = (np.concatenate([x[k] for x in shard]) for k in (1, 2, 3, 4))
        runs = [r for x in shard for r in x[5]]
        size = np.array([len(r) for r in runs], np.int64) // np.dtype(scheme.packed).itemsize
        off = np.concatenate(([0], np.cumsum(size)))
        symbols = np.frombuffer(b"".join(runs), scheme.packed)
        found = scheme.index(symbols, off, scheme.window)
        row = np.searchsorted(off, found, "right") - 1
        return marks(d[row], v[row], u[row], q[row] + found - off[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, symbols = [], 0
        seen = None  # the last run
        window = (None,) * 6  # the first row of the last hot window
        for batch in batches:
            h, c, kind, d, v, u, q = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            done = kind == _DUP
            if done.any():
                yield _rows(_MARK.names, d[done], v[done], u[done], q[done])
            hot = kind == _HOT
            if hot.any():
                w1, w2, *own = (x[hot] for x in (h, c, d, v, u, q))
                first = _groups(w1, w2)
                if (int(w1[0]), int(w2[0])) == window[:2]:
                    first[0] = False
                opened = np.cumsum(first) - 1
                heads = np.flatnonzero(first)
                lead = np.where(opened >= 0, heads[opened] if len(heads) else 0, 0)
                theirs = [np.where(opened >= 0, x[lead], w if w is not None else 0) for x, w in zip(own, window[2:], strict=True)]
                again = ~first & _differ(*zip(own, theirs, strict=True))
                yield marks(*(x[again] for x in own))
                window = (int(w1[-1]), int(w2[-1]), *(int(x[-1]) for x in theirs))
            cold = np.flatnonzero(kind == _BORDER)
            if not len(cold):
                continue
            # documents whose rows repeat send their runs more than once
            fresh = _groups(*(x[cold] for x in (h, d, v, u, q)))
            if tuple(int(x[cold[0]]) for x in (h, d, v, u, q)) == seen:
                fresh[0] = False
            seen = tuple(int(x[cold[-1]]) for x in (h, d, v, u, q))
            cold = cold[fresh]
            if not len(cold):
                continue
            runs = batch.column(7)
            begin = np.flatnonzero(_groups(h[cold]))
            for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(cold)], strict=True):
                at = cold[x:y]
                if symbols >= scheme.shard_symbols and shard[-1][0] != h[at[0]]:
                    yield indexed(shard)
                    shard, symbols = [], 0
                got = [runs[int(k)].as_py() for k in at]
                shard.append((h[at[0]], d[at], v[at], u[at], q[at], got))
                symbols += sum(map(len, got)) // np.dtype(scheme.packed).itemsize
        if shard:
            yield indexed(shard)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``d``, ``v``, ``u``, ``text`` and ``rest``: the id (null as the least), 128 bits of hash of the text that tell rows
    with one id apart, the text (null as empty), and the columns ``keep`` as a struct.

    None of the first three can be null, so no join puts a filter before the shuffle of the texts, and one shuffle can be used twice.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]) if keep else F.lit(0)
    zero = F.lit(0).cast("long")
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("d"), F.coalesce(F.xxhash64(text), zero).alias("v"),
        F.coalesce(F.xxhash64(F.lit("text"), text), zero).alias("u"), text.alias("text"), rest.alias("rest"),
    )


def repeated(docs: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """For ``keyed`` documents: themselves and, per identity, ``spans``, the repeated windows as an array of ``q1 << 32 | q2``."""
    n = partitions(docs.sparkSession)
    found = docs.select(*_WHO, "text").mapInArrow(trimmed(_find(scheme)), _ANCHOR).repartition(n, "h").sortWithinPartitions("h", "c", *_WHO, "loc")
    found = stored(found.mapInArrow(trimmed(_sorted_out(scheme.hot)), _FOUND))
    told = found.filter(F.col("kind") > _DUP).groupBy(*_WHO).agg(F.collect_list(F.struct("kind", "loc", "h")).alias("told"))
    # with the same columns as in ``with_repeats``, so that one shuffle of the texts serves both
    borders = docs.join(told, _WHO).select(*_WHO, "text", "told", "rest").mapInArrow(trimmed(_borders(scheme)), _RUN)
    late = borders.repartition(n, "h").sortWithinPartitions("h", "c", *_WHO, "q").mapInArrow(trimmed(_shards(scheme)), _MARK)
    spans = found.filter(F.col("kind") == _DUP).select(*_WHO, F.col("loc").alias("span")).union(late)
    return docs, spans.groupBy(*_WHO).agg(F.collect_set("span").alias("spans"))


def with_repeats(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """``docs`` (``keyed``) with ``spans``, null where nothing repeats."""
    docs, spans = repeated(docs, scheme)
    return docs.join(spans, _WHO, "left").select("d", "text", "spans", "rest")


def covers(spans: pa.ListArray, sym_off: np.ndarray, window: int, rows: slice) -> np.ndarray:
    """Which symbols of the texts at ``sym_off`` the repeated windows of list rows ``rows`` cover."""
    part = spans.slice(rows.start, rows.stop - rows.start)
    length = np.diff(part.offsets.to_numpy())
    if part.null_count:
        length = np.where(part.is_valid().to_numpy(zero_copy_only=False), length, 0)
    row = np.repeat(np.arange(len(part)), length)
    packed = part.flatten().to_numpy(zero_copy_only=False)
    change = np.zeros(int(sym_off[-1]) + 1, np.int64)
    np.add.at(change, sym_off[row] + (packed >> 32), 1)
    np.add.at(change, sym_off[row] + (packed & _LOW) + window, -1)
    return np.cumsum(change[:-1]) > 0
