"""SentencePiece byte-pair encoding and decoding by suffix-array matching.

A batch's distinct words are laid end to end and indexed by a suffix array.
Every piece of the vocabulary is looked up in it by binary search, all pieces
at once; each occurrence is an edge from its start to its end.  The edges are
sorted by position and relaxed in that order.  In a merge vocabulary the best
path is not a sum of scores: the path to each position ends in the one edge
whose piece follows the last piece of the path to its start without a merge
across the joint, and that test needs only the two pieces (``follows``).

Words are separated where no piece can cross: before spaces, and between two
characters that no piece holds side by side.  For words that start with two
spaces the test fails, as the merges that make their pieces have equal scores:
they are merged pair by pair instead (``merged``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces as byte_pieces
from .common import text_buffer, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of distinct words in one suffix array.
BATCH_CHARS = 1 << 17
#: Bytes of texts that are encoded together, and ids that are decoded together.
ENCODED_BYTES, DECODED_IDS = 1 << 22, 1 << 19
#: Words that a worker keeps encoded.
KEPT_WORDS = 1 << 19
SPACE_MARK = "▁"
_NEVER = 1 << 40
_SEEN_BITS = 20


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SEEN_BITS)


@dataclass
class Vocabulary:
    """Pieces of a merge model with byte fallback, and what the search needs of them."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    prefix_space: bool = True
    rank: np.ndarray = field(init=False)  # by id, when a piece is merged; -1 for characters
    left: np.ndarray = field(init=False)
    right: np.ndarray = field(init=False)
    usable: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        n = len(self.pieces)
        order = sorted((i for i in range(n) if self.normal[i] and len(self.pieces[i]) > 1), key=lambda i: -self.scores[i])
        self.rank, at, last = np.full(n + 1, -1, np.int64), -1, None
        for i in order:
            if self.scores[i] != last:
                at, last = at + 1, self.scores[i]
            self.rank[i] = at
        self.left, self.right, self.usable = np.full(n + 1, -1), np.full(n + 1, -1), np.zeros(n + 1, bool)
        for i, p in enumerate(self.pieces):
            if not self.normal[i]:
                continue
            if len(p) == 1:
                self.usable[i] = True
                continue
            parts, (a, b) = self._merge(p)
            if len(parts) == 1:
                self.usable[i], self.left[i], self.right[i] = True, a, b
        self.inner = {c for p in self.id_of if len(p) > 1 for c in p}
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in self.id_of for a, b in zip(p, p[1:], strict=False)}), np.int64)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id_of):
            raise ValueError("pieces that run over a space are not supported")
        made = np.flatnonzero(self.usable & (self.left >= 0))
        key = self.left[made] * (n + 1) + self.right[made]
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], self.rank[made][order]
        self.pair_seen = np.zeros(1 << _SEEN_BITS, bool)  # by hash; most pairs are not in the vocabulary
        self.pair_seen[_slot(self.pair_key)] = True
        self.longest = max((len(self.pieces[i]) for i in made), default=1)
        self.codes = np.array(sorted(map(ord, self.inner)), np.int64)  # characters of longer pieces; all others are one code
        self.bits = int(len(self.codes) + 1).bit_length()
        self.top = int(self.codes.max(initial=0)) + 1
        self.code_of = np.full(self.top + 1, len(self.codes) + 1, np.int64)  # by character; the last for all above
        self.code_of[self.codes] = np.arange(len(self.codes)) + 1
        self.per_word = 63 // self.bits
        single = sorted((ord(self.pieces[i]), i) for i in np.flatnonzero(self.usable[:n]).tolist() if len(self.pieces[i]) == 1)
        self.single_of = np.full(max([self.top, *(c + 1 for c, _ in single)]) + 1, -1, np.int64)  # id by character, -1 where none; the last for all above
        for c, i in single:
            self.single_of[c] = i
        self.long_pieces = np.array(sorted((i for i in made.tolist()), key=lambda i: self.pieces[i]), np.int64)
        length = np.array([len(self.pieces[i]) for i in self.long_pieces], np.int64)
        chars = np.zeros((len(length), self.longest), np.int64)
        for k, i in enumerate(self.long_pieces):
            chars[k, : length[k]] = self._coded(np.array([ord(c) for c in self.pieces[i]]))
        self.piece_length, self.piece_words = length, self._packed(chars)
        full = (np.arange(self.longest) < length[:, None]).astype(np.int64) * ((1 << self.bits) - 1)
        self.piece_mask = self._packed(full)
        head = np.minimum(length, self.per_word)
        self.piece_after = self.piece_words[:, 0] + (np.int64(1) << (self.bits * (self.per_word - head))) if len(length) else length
        surface = [p.replace(SPACE_MARK, " ").encode() if self.normal[i] else b"" for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            surface[i] = bytes([b])
        self.surface_off = np.concatenate(([0], np.cumsum([len(s) for s in surface])))
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def _merge(self, word: str) -> tuple[list[int], tuple[int, int]]:
        """Ids (-1 - code for characters without one) by merging the best pair, leftmost first, and the last pair merged."""
        ids = [self.id_of.get(c, -1 - ord(c)) for c in word]
        text, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, int, int]] = []
        last = (-1, -1)

        def offer(i: int, j: int) -> None:
            if j < len(text):
                whole = self.id_of.get(text[i] + text[j])
                if whole is not None:
                    heapq.heappush(heap, (int(self.rank[whole]), i, j, len(text[i]) + len(text[j])))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not text[i] or after[i] != j or j >= len(text) or len(text[i]) + len(text[j]) != size:
                continue
            last = (ids[i], ids[j])
            text[i] += text[j]
            ids[i] = self.id_of[text[i]]
            text[j] = ""
            after[i] = after[j]
            if after[i] < len(text):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [ids[i] for i in range(len(word)) if text[i]], last

    def fallback(self, ids: list[int]) -> list[int]:
        return [x for i in ids for x in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode()])]

    def merged(self, word: str) -> list[int]:
        return self.fallback(self._merge(word)[0])

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the text of pieces ``a`` and ``b`` together leaves both whole.

        The merges that made them are undone, the latest first.  A merge of the
        two pieces at the joint that comes before the one just undone would have
        been made instead.
        """
        n = len(self.pieces)
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER)
        good, rest = np.ones(len(a), bool), np.arange(len(a))
        while len(rest):
            x, y = a[rest], b[rest]
            key = x * (n + 1) + y
            crossed = self.pair_seen[_slot(key)]
            seen = np.flatnonzero(crossed)
            at = np.minimum(np.searchsorted(self.pair_key, key[seen]), len(self.pair_key) - 1)
            crossed[seen] = (self.pair_key[at] == key[seen]) & (self.pair_rank[at] < limit[rest[seen]])
            good[rest[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~crossed & ((rx >= 0) | (ry >= 0))
            rest, x, y, rx, ry = rest[more], x[more], y[more], rx[more], ry[more]
            undo_left = rx > ry
            limit[rest] = np.where(undo_left, rx, ry + 1)
            a[rest] = np.where(undo_left, self.right[x], x)
            b[rest] = np.where(undo_left, y, self.left[y])
        return good

    def _coded(self, chars: np.ndarray) -> np.ndarray:
        """Characters as small numbers from 1; those of no longer piece share the last."""
        return self.code_of[np.minimum(chars, self.top)]

    def _packed(self, chars: np.ndarray) -> np.ndarray:
        """Rows of small numbers, several to an integer, so that they compare as the rows do."""
        n, m = chars.shape
        words = -(-m // self.per_word)
        out = np.zeros((n, words), np.int64)
        for k in range(m):
            out[:, k // self.per_word] |= chars[:, k] << (self.bits * (self.per_word - 1 - k % self.per_word))
        return out

    def edges(self, chars: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every occurrence of a piece inside the words at ``off``.

        Suffixes are sorted by as many characters as the longest piece has.  The
        first packed word bounds each piece's range; binary search over all
        pieces at once narrows those that are longer.
        """
        n = len(chars)
        of = self.single_of[np.minimum(chars, len(self.single_of) - 1)]
        have = np.flatnonzero(of >= 0)
        single = have, have + 1, of[have]
        room = np.repeat(off[1:], np.diff(off)) - np.arange(n)
        code = self._coded(chars)
        packed = [np.zeros(n, np.int64)]
        for k in range(min(self.per_word, n)):
            packed[0][: n - k] |= np.where(room[: n - k] > k, code[k:], 0) << (self.bits * (self.per_word - 1 - k))
        for k in range(self.per_word, self.longest, self.per_word):  # the same characters, from the suffix that begins there
            packed.append(np.zeros(n, np.int64))
            packed[-1][: max(n - k, 0)] = np.where(room[: max(n - k, 0)] > k, packed[0][k:], 0)
        suffixes = np.lexsort(packed[::-1])
        words = np.stack([w[suffixes] for w in packed], axis=1)
        low, high = np.searchsorted(words[:, 0], self.piece_words[:, 0]), np.searchsorted(words[:, 0], self.piece_after)
        longer = np.flatnonzero((self.piece_length > self.per_word) & (low < high))
        first, last = (self._bound(words, longer, low[longer], high[longer], strict) for strict in (False, True))
        low[longer], high[longer] = first, last
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        start = suffixes[low[which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        found = start, start + self.piece_length[which], self.long_pieces[which]
        return tuple(np.concatenate(x) for x in zip(single, found, strict=True))

    def _bound(self, words: np.ndarray, piece: np.ndarray, low: np.ndarray, high: np.ndarray, strict: bool) -> np.ndarray:
        """For each piece the first suffix in its range that is not before it (after it, if ``strict``)."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid, p = (low[open_] + high[open_]) // 2, piece[open_]
            less, tied = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k in range(1, words.shape[1]):
                have, want = words[mid, k] & self.piece_mask[p, k], self.piece_words[p, k]
                less |= tied & (have < want)
                tied &= have == want
            if strict:
                less |= tied
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        return low

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (which begin with at most one space mark), one after another, and their numbers."""
        none = len(self.pieces)
        words_off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # parts of words: no piece has the characters at a border side by side
        pair = chars[:-1] << 21 | chars[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), max(len(self.beside) - 1, 0))
        apart = np.flatnonzero(self.beside[at] != pair) + 1 if len(self.beside) else np.arange(1, len(chars))
        off = np.union1d(words_off, apart)
        size, part_of = np.diff(off), np.searchsorted(words_off, off[:-1], "right") - 1
        start, end, piece = self.edges(chars, off)
        known = np.zeros(len(chars), bool)
        known[start[end - start == 1]] = True
        alone = np.flatnonzero(~known)  # characters without a piece: nothing merges with them
        start, end, piece = (np.concatenate(x) for x in ((start, alone), (end, alone + 1), (piece, np.full(len(alone), none))))
        begin = np.repeat(off[:-1], size)  # of the word that a position is in
        depth = (end - begin[start]).astype(np.int32)
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        opens = start == begin[start]
        cut = np.searchsorted(depth, np.arange(1, int(size.max(initial=0)) + 2))
        best, came = np.full(len(chars) + 1, -1), np.zeros(len(chars) + 1, np.int64)  # by end position
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            s, e, p, ok = start[a:b], end[a:b], piece[a:b], opens[a:b].copy()
            inner = np.flatnonzero(~ok)
            ok[inner] = self.follows(best[s[inner]], p[inner])
            best[e[ok]], came[e[ok]] = p[ok], s[ok]
        # back from the ends, one piece of every word at a time
        ids, owner, place = [], [], []
        word, at = np.arange(len(size)), off[1:].copy()
        step = 0
        while len(word):
            more = at > off[word]
            word, at = word[more], at[more]
            got = best[at]
            ids.append(np.where(got == none, -1 - chars[at - 1], got))
            owner.append(word)
            place.append(np.full(len(word), -step))
            at = came[at]
            step += 1
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.lexsort((np.concatenate(place), owner))
        ids, owner = ids[order], owner[order]
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            data = [[self.byte_ids[b] for b in chr(-1 - i).encode()] for i in ids[lost].tolist()]
            times = np.ones(len(ids), np.int64)
            times[lost] = [len(x) for x in data]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[ids < 0] = [x for d in data for x in d]
        return ids.astype(np.int32), np.bincount(part_of[owner], minlength=len(words))

    @cached_property
    def encoder(self) -> Encoder:
        """Kept with the broadcast vocabulary: the tasks of one worker share the words that they have met."""
        return Encoder(self)


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file (merge model, byte fallback, identity normalisation)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    normal = [not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in ids]
    return Vocabulary([p.id_to_piece(i) for i in ids], [p.get_score(i) for i in ids], normal, byte_ids)


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes texts; keeps the ids of words it has met, until they are more than ``KEPT_WORDS``."""

    def __init__(self, vocabulary: Vocabulary):
        import re

        self.vocabulary = vocabulary
        apart = "".join(re.escape(c) for c in "\n\t\r" if c not in vocabulary.inner)
        self.split = re.compile(rf"{SPACE_MARK}+[^{SPACE_MARK}{apart}]*|[^{SPACE_MARK}{apart}]+" + (f"|[{apart}]" if apart else ""))
        self._reset()

    def _reset(self) -> None:
        self.index = _Numbers()
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)  # of each word its ids in ``flat``

    def _learn(self, words: list[str]) -> None:
        doubled = np.fromiter((w[:2] == SPACE_MARK * 2 for w in words), bool, len(words))
        order = np.argsort(doubled, kind="stable")
        order[: len(words) - doubled.sum()] = sorted(order[: len(words) - doubled.sum()].tolist(), key=words.__getitem__)  # near words use near memory
        plain = [words[i] for i in order[: len(words) - doubled.sum()].tolist()]
        size = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        at, parts = 0, []
        while at < len(plain):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_CHARS)))
            parts.append(self.vocabulary.encoded(plain[at:to]))
            at = to
        for i in np.flatnonzero(doubled).tolist():
            ids = self.vocabulary.merged(words[i])
            parts.append((np.array(ids, np.int32), np.array([len(ids)])))
        flat, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        begin, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], sizes[order] = len(self.flat) + np.cumsum(size) - size, size
        self.begin, self.size, self.flat = (np.concatenate(x) for x in ((self.begin, begin), (self.size, sizes), (self.flat, flat)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and offsets."""
        known = len(self.index)
        if known > KEPT_WORDS or known != len(self.size):  # the latter after a call that failed
            self._reset()
            known = 0
        split = [self.split.findall(SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        words = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if len(self.index) > known:
            self._learn(list(islice(self.index, known, None)))
        size = self.size[words]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.flat[np.repeat(self.begin[words] - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.concatenate(([0], np.cumsum([len(s) for s in split], dtype=np.int64)))]


def decoded(vocabulary: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """Texts of lists of ids; ids outside the vocabulary raise IndexError."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.pieces)):
        raise IndexError("an id is outside the vocabulary")
    begin = vocabulary.surface_off[ids]
    size = vocabulary.surface_off[ids + 1] - begin
    total = np.concatenate(([0], np.cumsum(size)))
    data = vocabulary.surface[np.repeat(begin - total[:-1], size) + np.arange(total[-1])].tobytes()
    at = total[off].tolist()
    return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(at, at[1:], strict=False)]


def _encoding(vocabulary: Broadcast):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.value.encoder
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in byte_pieces(off, ENCODED_BYTES):
                texts = ["" if t is None else t for t in batch.column(1).slice(i, j - i).to_pylist()]
                ids, at = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), lists], names=["id", "n_tokens", "ids"])

    return run


def _decoding(vocabulary: Broadcast, column: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in byte_pieces(np.concatenate(([0], np.cumsum(size))), DECODED_IDS):
                part = batch.slice(i, j - i)
                texts = decoded(vocabulary.value, part.column(column).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size[i:j]))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[str(k) for k in range(part.num_columns + 1)])

    return run


def _shared(df: DataFrame, model: str) -> Broadcast:
    """The vocabulary for all tasks (its size is that of the model file, whatever the input)."""
    return df.sparkSession.sparkContext.broadcast(load(model))


def _coded_schema(docs: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` of each row.

    Null and empty texts have no ids.  Repeated rows and null ids are kept; an
    empty table gives an empty table; other columns are not read.
    """
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(_encoding(_shared(docs, model))), _coded_schema(docs, id_col))


def decode(coded: DataFrame, ids_col: str = "ids", model: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """``coded`` with the column ``out_col``, the texts of ``ids_col`` (null is empty)."""
    return coded.mapInArrow(trimmed(_decoding(_shared(coded, model), coded.columns.index(ids_col))), T.StructType([*coded.schema.fields, T.StructField(out_col, T.StringType())]))


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """``decode`` of ``encode``, in one pass over the rows."""
    vocabulary, schema = _shared(docs, model), _coded_schema(docs, id_col)
    both = lambda batches: _decoding(vocabulary, 2)(_encoding(vocabulary)(batches))
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(both), T.StructType([*schema.fields, T.StructField(out_col, T.StringType())]))
