"""The trie of conversations' first turns, built compressed from their sorted order.

A turn is a digest of role and text with the text's length, 20 bytes, and a
conversation the sequence of its turns, so that sorting these sequences puts
equal beginnings side by side.  Sequences are sorted by ranges over all tasks;
each task walks its block once and makes, from what neighbours share, only the
points where paths branch, where conversations end, and those that its block
shares with the next ones.  A point takes the sums of its subtree when the walk
leaves it; sums of shared points are added up over blocks.  At the end each edge
is expanded into its unary nodes, whose totals are the lower point's and sums
over the rest of the edge.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, trimmed

#: Bytes of a turn: a digest and the length of its text.
DIGEST, TURN = 16, 20
#: Conversations that share a head: those of one run of so many ids; and the most turns of a head, less one.
RUN, HEADS = 100, 6
#: Ids of ends are put together in runs of 2 ** ID_BITS before they meet in one task.
ID_BITS = 12
#: Points that tasks send in one batch.
BATCH = 4096


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv`` and ``own``, its turns in order as (``h``, ``n``); by ``turn``, null first, ties by digest.  Texts stay where they are read."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.col(f"`{turn_col}`").cast("long")
    rows = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.struct(turn.isNotNull().alias("k"), F.coalesce(turn, F.lit(0)).alias("t"), digest.alias("h"), F.length(text).alias("n")).alias("x")
    ).filter("conv IS NOT NULL")
    # heads come from the first conversation of a run of ids: dealt by run, all that follows needs no further shuffle
    rows = rows.withColumn("run", F.col("conv") - F.col("conv") % RUN).repartition(partitions(conversations.sparkSession), "run")
    return rows.groupBy("run", "conv").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x.h.alias("h"), x.n.alias("n"))).alias("own"))


def rebuilt(own: DataFrame) -> DataFrame:
    """``conv`` and ``path``: the turns of the conversation after its head was replaced, ``TURN`` bytes each."""
    none = F.slice("own", 1, 0)
    head = F.max(F.when(F.col("conv") == F.col("run"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("run"))  # at most RUN rows
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS)).cast("int")
    both = F.concat(F.slice(F.coalesce("head", none), F.lit(1), "h"), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    path = F.unhex(F.array_join(F.transform(both, lambda x: F.concat(F.hex(x.h), F.lpad(F.hex(x.n.cast("long")), 8, "0"))), ""))
    return own.withColumn("head", head).withColumn("h", h).select("conv", path.alias("path"))


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """How many turns two paths begin with alike; -1 if one is missing."""
    if a is None or b is None:
        return -1
    m = min(len(a), len(b))
    differ = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return (m - (differ.bit_length() + 7) // 8) // TURN


@dataclass
class Point:
    """A point on the path of the row before: sums over what of its subtree was walked."""

    depth: int
    id: bytes
    new: bool  # no earlier block has it
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    spent: int = 0  # members x characters of nodes
    distinct: int = 0  # characters of nodes

    def take(self, child: Point, edge: int, new_child: bool) -> None:
        """Add a finished child at the end of an edge whose inner nodes have ``edge`` characters."""
        self.n += child.n
        self.least = child.least if self.least is None else min(self.least, child.least)
        self.children += new_child
        self.leaves += child.leaves
        self.spent += child.spent + child.n * edge
        self.distinct += child.distinct + edge


class Walk:
    """One pass over a block of sorted paths; ``out`` gets finished points."""

    def __init__(self) -> None:
        self.stack: list[Point] = []
        self.out: list[tuple] = []
        self.before: bytes | None = None  # the last path of the block before, then of this one
        self.path: bytes | None = None
        self.sums = np.zeros(1, np.int64)

    def _leave(self, point: Point, parent: Point | None) -> None:
        """Finish a point below ``parent``: its own text counts, and its edge is written."""
        sums, d = self.sums, point.depth
        if d:
            own = int(sums[d] - sums[d - 1])
            point.spent += point.n * own
            point.distinct += own * point.new
        top = parent.depth + 1 if parent else 0
        tail = (sums[d - 1] - sums[np.arange(top, d + 1) - 1]) if parent else np.zeros(1, np.int64)
        self.out.append((point.id, point.depth, parent and parent.id, point.n, point.least, point.children, point.leaves, point.spent, point.distinct, tail))
        if parent:
            parent.take(point, int(tail[0]), point.new or d > top)

    def _down_to(self, depth: int, every: int = -1) -> None:
        """Leave all points below ``depth``, which becomes a point; on the last path every depth up to ``every`` is one too."""
        while self.stack and self.stack[-1].depth > depth:
            point = self.stack.pop()
            above = self.stack[-1].depth if self.stack else -1
            next_depth = max(above, depth, min(every, point.depth - 1))
            if next_depth < 0:
                self._leave(point, None)
                return
            if next_depth > above:
                self.stack.append(Point(next_depth, hashlib.md5(self.path[: next_depth * TURN]).digest(), True))
            self._leave(point, self.stack[-1])

    def row(self, path: bytes, n: int, least: int, following: bytes | None) -> None:
        shared = shared_turns(self.before, path)
        length = len(path) // TURN
        if self.path is None:  # the first of the block: what the block before has of its path
            digest = hashlib.md5()
            for d in range(max(shared, 0) + 1):
                self.stack.append(Point(d, digest.copy().digest(), d > shared))
                digest.update(path[d * TURN : (d + 1) * TURN])
        else:
            self._down_to(shared)
        self.before = self.path = path
        self.sums = np.concatenate(([0], np.cumsum(np.frombuffer(path, np.dtype([("h", f"V{DIGEST}"), ("n", ">u4")]))["n"], dtype=np.int64)))
        if not self.stack or self.stack[-1].depth < length:
            self.stack.append(Point(length, hashlib.md5(path).digest(), True))
        end = self.stack[-1]
        end.n += n
        end.least = least if end.least is None else min(end.least, least)
        end.leaves += shared_turns(path, following) < length

    def end(self, following: bytes | None) -> None:
        if self.path is not None:
            self._down_to(-1, max(shared_turns(self.path, following), 0))


_POINTS = "id binary, depth long, parent binary, n long, least long, children long, leaves long, spent long, distinct long, tail array<long>"
_BEFORE, _ROW, _AFTER = 0, 1, 2


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of whole blocks, whose rows come in order between the last path of the block before and the first of the next."""
    schema = pa.schema([("id", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("n", "least", "children", "leaves", "spent", "distinct")], ("tail", pa.list_(pa.int64()))])

    def sent(points: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*points, strict=True), schema, strict=True)], schema=schema)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)

    for _, block in itertools.groupby(rows(), operator.itemgetter(0)):
        walk, held, after = Walk(), None, None
        for _, kind, path, n, least in block:
            if kind == _BEFORE:
                walk.before = path
                continue
            if held:
                walk.row(*held, path)
            held, after = ((path, n, least), None) if kind == _ROW else (None, path)
            if len(walk.out) >= BATCH:
                yield sent(walk.out)
                walk.out = []
        if held:
            walk.row(*held, None)
        walk.end(after)
        if walk.out:
            yield sent(walk.out)


def compressed(paths: DataFrame) -> DataFrame:
    """The points of the compressed trie of ``path``s (with ``n`` members, the ``least`` of them), with the sums of their subtrees.

    ``tail`` holds, for each node of the edge above a point and the point
    itself, from the top, the characters of the nodes from there to just above
    the point.
    """
    n = partitions(paths.sparkSession)
    ordered = stored(paths.repartitionByRange(n, "path").sortWithinPartitions("path").withColumn("block", F.spark_partition_id()))
    edges = ordered.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last"))  # a row a task
    in_order = Window.orderBy("block")
    edges = edges.select("block", F.lag("last").over(in_order).alias("before"), F.lead("first").over(in_order).alias("after"))
    edges = edges.select("block", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("path")) for k, c in ((_BEFORE, "before"), (_AFTER, "after"))])).alias("x"))
    none = F.lit(None).cast("long")
    edges = edges.select("block", "x.kind", "x.path", none.alias("n"), none.alias("least")).filter("path IS NOT NULL")
    rows = ordered.select("block", F.lit(_ROW).alias("kind"), "path", "n", "least").union(edges)
    local = rows.repartition(n, "block").sortWithinPartitions("block", "kind", "path").mapInArrow(trimmed(_walked), _POINTS)
    return local.groupBy("id").agg(
        F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "spent", "distinct")],
        F.min("least").alias("least"), F.any_value("tail").alias("tail"),
    )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each id, which come in order."""
    at, digest = None, None
    for batch in batches:
        ids, out = [], []
        for i, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i == at:
                digest.update(b"," + piece.encode())
                continue
            if at is not None:
                ids.append(at)
                out.append(digest.hexdigest())
            at, digest = i, hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], names=["id", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["id", "ends"])


def ends(members: DataFrame) -> DataFrame:
    """``id`` of a path and ``ends``, the digest of its conversations' ids in order.

    Ids are first sorted and joined in runs; of a path with very many copies
    only the joined runs, one for thousands of ids, are read by one task, as a
    stream: the digest is of one long string.
    """
    runs = members.groupBy(F.unhex(F.md5("path")).alias("id"), F.shiftright("conv", ID_BITS).alias("at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("piece")
    )
    return runs.repartition(partitions(members.sparkSession), "id").sortWithinPartitions("id", "at").select("id", "piece").mapInArrow(trimmed(_digested), "id binary, ends string")


def expanded(points: DataFrame, ended: DataFrame) -> DataFrame:
    """All nodes of the trie: each edge of the compressed one gives its unary nodes and the point below."""
    points = points.join(ended, "id", "left")
    parents = points.select(F.col("id").alias("parent"), F.col("least").alias("parent_conv"))
    nodes = points.join(parents, "parent", "left").select("*", F.posexplode("tail").alias("k", "rest"), (F.col("depth") - F.size("tail") + 1).alias("top"))
    is_point = F.col("k") + 1 == F.size("tail")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.select(
        F.col("least").alias("conv_id"), (F.col("top") + F.col("k")).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("parent_conv")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(is_point, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("spent") - F.col("distinct") + (F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), F.when(is_point, F.coalesce("ends", F.lit(nothing))).otherwise(nothing).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per node of the trie of rebuilt conversations: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are ordered by number, null first; of equal numbers the order is that
    of a digest of role and text (the same wherever rows are).  Null role or
    text is empty.  Repeated rows are turns of their own.  Rows without a
    conversation's id belong to none.  The first id of a run is ``id - id %
    100`` with the remainder's sign that of the id.  An empty table has no
    node, not even a root; other columns are not read.
    """
    members = stored(rebuilt(turns(conversations, id_col, turn_col, role_col, text_col)))
    paths = members.groupBy("path").agg(F.count("*").alias("n"), F.min("conv").alias("least"))
    return expanded(stored(compressed(paths)), ends(members))
