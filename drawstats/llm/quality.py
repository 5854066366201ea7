"""Quality rules with suffix-array repetition.

The words of a piece of many documents are ranked by prefix doubling with the
document in the first rank, so that suffixes of different documents never
meet.  Only starts that are still tied are sorted again at each doubling.  The
common prefixes of neighbours in suffix order form intervals; an interval whose
occurrences follow different words is a maximal repeated substring.  The union
of their spans, and the longest of them, are what the rule limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, RangeHash, pieces, text_buffer, trimmed, union_spans, words_of

#: Words in the windows of the base rule.
WINDOW = 8
#: The base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The method's rule: repeats of at least so many words count; they may cover so much of a
#: document, and none may be longer than so many words.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_LONGEST = 5, 25, 60
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"


def suffix_ranks(symbol: np.ndarray, doc: np.ndarray, level: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, .. words, until none is tied, and the starts tied after ``2 ** level`` words.

    ``symbol`` must differ between documents.  A suffix ends with its document.
    """
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    rank = _group_starts(symbol[order])
    back = np.empty(n, np.int64)
    back[order] = rank
    ranks, tied, step = [back], _ties(back, np.arange(n)), 1
    wanted = tied
    while len(tied):
        now = ranks[-1].copy()
        there = tied + step
        inside = there < n
        second = np.zeros(len(tied), np.int64)
        there = np.minimum(there, n - 1)
        inside &= doc[there] == doc[tied]
        second[inside] = ranks[-1][there[inside]] + 1
        order = np.lexsort((second, now[tied]))
        at, first, second = tied[order], now[tied][order], second[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        begin = np.ones(len(at), bool)
        begin[1:] = first[1:] != first[:-1]
        where = np.arange(len(at))
        now[at] = first + np.maximum.accumulate(np.where(fresh, where, 0)) - np.maximum.accumulate(np.where(begin, where, 0))
        ranks.append(now)
        tied = _ties(now, tied)
        step *= 2
        if len(ranks) <= level + 1:
            wanted = tied
    return ranks, wanted if len(ranks) > level else tied


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))


def _ties(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    values = rank[among]
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = np.zeros(len(v), bool)
    same[1:] = v[1:] == v[:-1]
    same[:-1] |= same[1:]
    return np.sort(among[order[same]])


def common_prefixes(ranks: list[np.ndarray], order: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Common prefix, in words, of each of the suffixes in ``order`` with the one before it (0 for the first)."""
    n = len(doc)
    a, b = order[:-1], order[1:]
    length = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        same = inside & (doc[x] == doc[a]) & (doc[y] == doc[b]) & (ranks[level][x] == ranks[level][y])
        length[same] += 1 << level
    return np.concatenate((np.zeros(min(1, len(order)), np.int64), length))


def _previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each entry the last one before it that is smaller (-1 if none); all look back at once, over what others have passed."""
    at = np.arange(len(x)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[x[at[open_]] >= x[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def maximal_repeats(ranks: list[np.ndarray], starts: np.ndarray, symbol: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (starts, lengths) of repeated substrings that no longer one at the same place extends.

    ``starts`` are all starts of repeats of the length of interest.  Each is in
    the interval of its longer common prefix with a neighbour; it counts if
    that interval's occurrences do not all follow the same word.
    """
    order = starts[np.argsort(ranks[-1][starts], kind="stable")]
    prefix = common_prefixes(ranks, order, doc)
    n = len(order)
    left = np.maximum(_previous_smaller(prefix), 0)
    right = n - 1 - np.maximum(_previous_smaller(prefix[::-1])[::-1], -1)
    right = np.where(right > n - 1, n, right)  # the interval at i has the suffixes left .. right - 1
    before = np.where(order > 0, symbol[np.maximum(order - 1, 0)], np.uint64(0))
    before = np.where((order > 0) & (doc[np.maximum(order - 1, 0)] == doc[order]), before, order.astype(np.uint64))
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1]))) if n else np.zeros(0, np.int64)
    following = np.append(prefix[1:], 0)
    deepest = np.where(following > prefix, np.minimum(np.arange(n) + 1, n - 1), np.arange(n))
    diverse = changes[right[deepest] - 1] != changes[left[deepest]]
    return order[diverse], np.maximum(prefix, following)[diverse]


def repetition(raw: np.ndarray, off: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Per text: words, words in repeated windows, words covered by repeats, the longest repeat."""
    starts, ends, doc = words_of(raw, off)
    n_rows, n = len(off) - 1, len(starts)
    out = {"n_words": np.bincount(doc, minlength=n_rows)}
    longest, cover, window = np.zeros(n_rows, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    if n:
        symbol = RangeHash(raw)(starts, ends) ^ RangeHash(doc.astype(np.uint64) + np.uint64(1), 1)(np.arange(n), np.arange(n) + 1)
        ranks, tied = suffix_ranks(symbol, doc, int(min(min_repeat, WINDOW)).bit_length() - 1)
        if len(tied):
            at, length = maximal_repeats(ranks, tied, symbol, doc)
            long = length >= min_repeat
            cover = union_spans(at[long], (at + length)[long], n)
            np.maximum.at(longest, doc[at[long]], length[long])
            wide = length >= WINDOW
            window = union_spans(at[wide], (at + length)[wide], n)
    return out | {"n_repeat_words": np.bincount(doc[window], minlength=n_rows), "covered_words": np.bincount(doc[cover], minlength=n_rows), "longest_repeat": longest}


def measured(raw: np.ndarray, off: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of the rules for the texts in a byte buffer."""
    out = repetition(raw, off, min_repeat)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[off[1:]] - total[off[:-1]]

    out["word_chars"] = per_text(~SPACE[raw] & ((raw & 0xC0) != 0x80))
    out["n_symbols"] = per_text(_SYMBOL[raw])
    data, dup = raw.tobytes(), []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        lines = [x for x in data[a:b].split(b"\n") if x.strip(_BLANK)]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, np.int64)
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, the columns in ``keep``, the counts, ``base_failed`` and ``kept`` of each row.

    ``kept`` is false if the base rule fails, if repeats of at least
    ``min_repeat`` words cover more than ``max_covered_percent`` of the words, or
    if a repeat is longer than ``max_longest`` words.  Null text has no words (and so fails); repeated rows
    and null ids are kept; an empty table gives an empty table.
    """
    if min_repeat < 1:
        raise ValueError("min_repeat under 1")
    names = [id_col, text_col, *[k for k in keep if k not in (id_col, text_col)]]
    sent = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            at = {c: k for k, c in enumerate(names)}
            for i, j in pieces(off):
                got = measured(raw[off[i] : off[j]], off[i : j + 1] - off[i], min_repeat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(at[c]).slice(i, j - i) for c in sent] + [pa.array(got[c].astype(np.int64)) for c in _COUNTS],
                    names=[str(k) for k in range(len(sent) + len(_COUNTS))],
                )

    inner = [f"k{i}" for i in range(len(sent))]
    schema = T.StructType([T.StructField(a, docs.schema[c].dataType) for a, c in zip(inner, sent, strict=True)] + [T.StructField(c, T.LongType()) for c in _COUNTS])
    out = docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(trimmed(run), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    bad = (100 * F.col("covered_words") > max_covered_percent * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    return out.select(
        *[F.col(a).alias(c) for a, c in zip(inner, sent, strict=True)], *_COUNTS, failed.alias("base_failed"), (~failed & ~bad).alias("kept")
    )
