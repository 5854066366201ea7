"""Token counts that follow edits.

The text of a document is cut into pre-tokens, none of which a token crosses.
A segment tree over short leaves of pre-tokens holds sums of characters and
tokens; it is kept beside the document as a binary column, so that later edits
start from it and not from the text.  An edit finds its leaves by characters, cuts again from the last
pre-token that could not have seen the edit until a new border falls on an old
one, encodes only what lies between, and updates the sums on the paths above.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, stored, text_buffer, trimmed

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past its end that a match of the pattern may look at.
LOOK_AHEAD = 2
#: Pre-tokens in a leaf when a tree is built, and the most before it is built anew.
LEAF, MOST_IN_LEAF = 32, 256
#: Pre-tokens whose counts a worker keeps.
KEPT = 1 << 18

Counter = Callable[[list[str]], list[int]]


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokens:
    """Splits texts and counts the tokens of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in parts]


class CountTree:
    """Pre-tokens of one text with sums of characters and tokens, made from the text or from what ``kept`` gave."""

    def __init__(self, text: str, tokens: Tokens, kept: bytes | None = None):
        self.tokens, self.text, self.encoded = tokens, text, 0
        if kept is None:
            parts = tokens.split(text)
            self._build(np.fromiter(map(len, parts), np.int64, len(parts)), np.array(tokens.counts(parts), np.int64))
        else:
            width = f"<u{kept[0]}"
            length, count = np.frombuffer(kept, width, offset=1).astype(np.int64).reshape(2, -1)
            if length.sum() != len(text):
                raise ValueError("the tree is of another text")
            self._build(length, count)

    def kept(self) -> bytes:
        """Lengths and token counts of the pre-tokens: a byte for their width, then both in order."""
        flat = np.array([v for k in (0, 1) for leaf in self.leaves for v in leaf[k]], np.int64)
        width = next(w for w in (1, 2, 4, 8) if not len(flat) or int(flat.max()) < 1 << (8 * w))
        return bytes([width]) + flat.astype(f"<u{width}").tobytes()

    @property
    def n_pretokens(self) -> int:
        return sum(len(x[0]) for x in self.leaves)

    def _build(self, length: np.ndarray, count: np.ndarray) -> None:
        n = max(1, -(-len(length) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        self.leaves = [(length[i : i + LEAF].tolist(), count[i : i + LEAF].tolist()) for i in range(0, max(1, len(length)), LEAF)]
        self.leaves += [([], []) for _ in range(self.size - len(self.leaves))]
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        at = np.arange(0, len(length), LEAF)
        if len(at):
            self.sums[self.size : self.size + len(at), 0] = np.add.reduceat(length, at)
            self.sums[self.size : self.size + len(at), 1] = np.add.reduceat(count, at)
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf with any, past the end) and where it begins."""
        node, begin = 1, 0
        at = min(at, int(self.sums[1, 0]) - 1)
        while node < self.size:
            node *= 2
            if at >= begin + self.sums[node, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.size, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of characters ``start`` to ``end``; both are moved into the text if they are outside."""
        old_size = len(self.text)
        start = min(max(start, 0), old_size)
        end = min(max(end, start), old_size)
        self.text = self.text[:start] + new + self.text[end:]
        if old_size == 0:
            parts = self.tokens.split(self.text)
            self.encoded += len(parts)
            self._build(np.fromiter(map(len, parts), np.int64, len(parts)), np.array(self.tokens.counts(parts), np.int64))
            return
        first, begin = self._leaf(max(0, start - LOOK_AHEAD))
        restart, index = begin, 0
        for size in self.leaves[first][0]:
            if restart + size + LOOK_AHEAD > start:
                break
            restart, index = restart + size, index + 1
        shift = len(new) - (end - start)
        # old borders after the edit, leaf by leaf, as far as they are needed
        last, border, at, keep, leaf_at = first, restart, restart, index, index
        made: list[str] = []
        match = self.tokens.pattern.match
        while True:
            while at - shift > border or (border < end and border < old_size):  # move the old border up to the new one
                while leaf_at >= len(self.leaves[last][0]):
                    last, leaf_at = last + 1, 0
                border += self.leaves[last][0][leaf_at]
                leaf_at += 1
            if at >= start + len(new) and at - shift == border:
                break
            m = match(self.text, at)
            made.append(m[0])
            at = m.end()
        lengths = [len(p) for p in made]
        counts = self.tokens.counts(made)
        self.encoded += len(made)
        head, tail = self.leaves[first], self.leaves[last]
        merged = (head[0][:keep] + lengths + tail[0][leaf_at:], head[1][:keep] + counts + tail[1][leaf_at:])
        for k in range(first, last + 1):
            self.leaves[k] = merged if k == first else ([], [])
            self._update(k)
        if len(merged[0]) > MOST_IN_LEAF:
            every = [x for x in self.leaves if x[0]]
            self._build(np.array([v for x in every for v in x[0]], np.int64), np.array([v for x in every for v in x[1]], np.int64))

    def _update(self, leaf: int) -> None:
        node = leaf + self.size
        self.sums[node] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


def sample_edits(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """A column of three edits (``start``, ``stop``, ``new``) that depends on the id and the length: an insertion, a replacement, a deletion."""
    size = F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0))
    out = []
    for k, (span, new) in enumerate(((0, " Edited: it's 2024's text,\n"), (17, "replacement"), (40, ""))):
        start = (F.crc32(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(f":{k}"))) % (size + 1)).cast("int")
        out.append(F.struct(start.alias("start"), (start + span).alias("stop"), F.lit(new).alias("new")))
    return F.array(*out)


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``trees`` with ``edits``, the array of a document's rows (``seq``, ``start``, ``stop``, ``new``) of a table of edits, in the order of ``seq``."""
    told = edits.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "new"))), lambda x: F.struct(x.start.alias("start"), x.stop.alias("stop"), x.new.alias("new"))).alias("edits"))
    return trees.join(told, id_col, "left")


def count_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Per row: ``id_col``, ``text``, ``n_tokens``, ``n_pretokens`` and ``tree`` (binary), for ``edited``.

    Null text is empty.  Repeated rows and null ids are kept; an empty table
    gives an empty table; other columns are not read.
    """
    table = read_ranks(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(table)
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                part = batch.slice(i, j - i)
                trees = [CountTree(t.as_py() or "", tokens) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).fill_null(""), pa.array([t.n_tokens for t in trees], pa.int64()), pa.array([t.n_pretokens for t in trees], pa.int64()), pa.array([t.kept() for t in trees], pa.binary())],
                    names=["id", "text", "n_tokens", "n_pretokens", "tree"],
                )

    fields = [("text", T.StringType()), ("n_tokens", T.LongType()), ("n_pretokens", T.LongType()), ("tree", T.BinaryType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(a, b) for a, b in fields]])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema)


def edited(trees: DataFrame, edits: F.Column, id_col: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """The rows of ``count_trees`` after their edits, with ``text`` and ``tree`` as they are then, ``n_edits``,
    ``n_tokens_after`` and ``n_recounted`` (pre-tokens encoded for the edits); ``n_tokens`` and ``n_pretokens`` are those before.

    ``edits`` is an array of (``start``, ``stop``, ``new``), applied in order,
    each to the text that the one before left; positions outside the text are
    moved into it, and null edits do nothing.
    """
    table = read_ranks(ranks)
    sent = trees.select(F.col(f"`{id_col}`"), "text", "n_tokens", "n_pretokens", "tree", edits.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(table)
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                part = batch.slice(i, j - i)
                rows = []
                for text, kept, told in zip(part.column(1), part.column(4), part.column(5).to_pylist(), strict=True):
                    tree, done = CountTree(text.as_py(), tokens, kept.as_py()), 0
                    for e in told or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                            done += 1
                    rows.append((tree.text, tree.kept(), done, tree.n_tokens, tree.encoded))
                texts, kept, *numbers = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), part.column(2), part.column(3), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in numbers)],
                    names=["id", "text", "n_tokens", "n_pretokens", "tree", *_AFTER],
                )

    return sent.mapInArrow(trimmed(run), T.StructType([*sent.schema.fields[:5], *[T.StructField(c, T.LongType()) for c in _AFTER]]))


_AFTER = ["n_edits", "n_tokens_after", "n_recounted"]


def counted(docs: DataFrame, edits: F.Column, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, ``n_pretokens``, ``n_edits``, ``n_tokens_after`` and ``n_recounted``.

    The trees are kept in the checkpoint folder, and the edits (see ``edited``;
    made of ``id_col`` and ``text``) are applied to them.
    """
    out = edited(stored(count_trees(docs, id_col, text_col, ranks)), edits, id_col, ranks)
    return out.select(F.col(f"`{id_col}`"), "n_tokens", "n_pretokens", *_AFTER)
