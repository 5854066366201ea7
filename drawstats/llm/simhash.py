"""SimHash near-duplicate classes by deletion-variant signatures.

A fingerprint has 64 bits.  Two fingerprints that differ in at most ``d`` bits,
cut into ``d // 2 + 1`` segments, agree up to one bit in at least one segment.
Each distinct fingerprint is indexed under every segment with one bit removed
(64 keys in all, whatever the number of segments); equal keys meet every pair
to be linked, and a bit count of the difference verifies it.
Copies with one fingerprint are one node, so they make no pairs.

Under a key all fingerprints near its least one are linked to that one; of the
other pairs only those are made whose ends these stars have not joined, so a
dense group makes about as many links as it has members.

Classes are the components of the verified links, found with alternating
large-star and small-star rounds over DataFrames.  Every round is written to
the shared checkpoint folder.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, discard, merged, partitions, pieces, stored, text_buffer, trimmed, words_of

SHINGLE, SEED, DISTANCE = 4, 42, 4


def simhash(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of the texts in a byte buffer."""
    raw = LOWER[raw]
    starts, ends, row = words_of(raw, off)
    n_rows = len(off) - 1
    # words joined by one space: each takes its length and one more byte
    length = ends - starts + 1
    new_end = np.cumsum(length)
    new_start = new_end - length
    joined = np.full(int(new_end[-1]) if len(length) else 0, 0x20, np.uint8)
    joined[np.repeat(new_start - starts, length - 1) + _ranges(starts, length - 1)] = raw[_ranges(starts, length - 1)]
    first = np.searchsorted(row, np.arange(n_rows), "left")
    count = np.searchsorted(row, np.arange(n_rows), "right") - first
    made = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    begin = np.repeat(first, made) + _within(made)
    last = np.minimum(begin + shingle, np.repeat(first + count, made)) - 1
    buffer, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(buffer[a:b], seed) for a, b in zip(new_start[begin].tolist(), (new_end[last] - 1).tolist(), strict=True)), np.uint64, len(begin)
    )
    return majority(hashes, made)


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run of ``count`` hashes the bits that more than half of them have."""
    out, at = np.zeros(len(count), np.uint64), np.concatenate(([0], np.cumsum(count)))
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in np.flatnonzero(count):
        part = hashes[at[i] : at[i + 1]]
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = weight[2 * ones > len(part)].sum(dtype=np.uint64)
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each run of the given lengths."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(start, length) + _within(length)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's bits as a long) of each row; null text is empty (0)."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                fp = simhash(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], names=["id", "fp"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", id_type), T.StructField("fp", T.LongType())])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema)


def _segments(d: int) -> list[tuple[int, int]]:
    n = d // 2 + 1
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


#: Parts of a segment.
PARTS = 3
#: A key with more fingerprints than this is cut again by slices.
HOT_KEY = 256


def _mask(bits: Iterable[int]) -> int:
    out = sum(1 << b for b in bits)
    return out - (1 << 64) if out >> 63 else out


def _slices(d: int) -> list[int]:
    """Masks of ``d + 1`` slices of every ``d + 1``-th bit; ``d`` differing bits leave one slice equal."""
    return [_mask(range(k, 64, d + 1)) for k in range(d + 1)]


def _parts(d: int) -> list[tuple[range, range]]:
    """Each part of each segment: the segment's bits and its own."""
    return [(range(low, low + width), range(low + width * i // PARTS, low + width * (i + 1) // PARTS)) for low, width in _segments(d) for i in range(PARTS)]


def _kept(bit: F.Column, d: int) -> F.Column:
    """The mask of what is left of a segment without ``bit``."""
    return F.get(F.array(*[F.lit(_mask(set(range(low, low + width)) - {b})) for low, width in _segments(d) for b in range(low, low + width)]), bit)


def _dealt(nodes: DataFrame, d: int) -> DataFrame:
    """Each row of ``nodes`` once a part, dealt to tasks by ``part`` and ``rest``, the bits of the segment outside of the part."""
    rest = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(set(whole) - set(part)))).alias("rest")) for i, (whole, part) in enumerate(_parts(d))]
    return nodes.select("*", F.inline(F.array(*rest))).repartition(partitions(nodes.sparkSession), "part", "rest")


def _keyed(rows: DataFrame, d: int) -> DataFrame:
    """Each of ``rows`` (``_dealt``) once a key: ``bit`` (the removed one, of the row's part) and ``left`` (what is left of the segment)."""
    bits = F.array(*[F.array(*map(F.lit, part)) for _, part in _parts(d)])
    return rows.select("*", F.explode(F.get(bits, "part")).alias("bit")).withColumn("left", F.col("fp").bitwiseAND(_kept(F.col("bit"), d)))


def _first(diff: F.Column, bit: F.Column, d: int) -> F.Column:
    """Whether the key without ``bit``, which two fingerprints with difference ``diff`` have, is the first that they have."""
    out, apart = F.lit(False), F.lit(True)
    for low, width in _segments(d):
        inside = diff.bitwiseAND(F.lit(_mask(range(low, low + width))))
        out = out | (bit.between(low, low + width - 1) & apart & ((inside != 0) | (bit == low)))
        apart = apart & (F.bit_count(inside) > 1)
    return out


def links(nodes: DataFrame, d: int = DISTANCE) -> DataFrame:
    """Pairs ``a < b`` of distinct values of ``nodes.fp`` that differ in 1 to ``d`` bits, enough of them to join all values
    that a chain of such differences joins.

    Fingerprints with one key have the segment's other parts in common, whole.
    They are dealt to tasks by those, a row a part, and keys are made where the
    rows lie, so that keys are not shuffled.

    Under each key every fingerprint is compared with the least one, which
    makes a star of a dense group and not all its pairs.  Of the others only
    pairs of different components of the stars are made, each once.  A key with
    many fingerprints is joined only within equal slices of the whole
    fingerprint, one of which every linked pair shares.
    """
    same = Window.partitionBy("left", "bit", "part", "rest")
    seen = _keyed(_dealt(nodes.select("fp"), d), d).select("*", F.min("fp").over(same).alias("least"), F.count("*").over(same).alias("size")).filter("size > 1")
    near = (F.col("fp") > F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= d)
    crowded = (F.col("fp") == F.col("least")) & (F.col("size") > HOT_KEY)
    found = seen.filter(near | crowded).select(F.when(near, F.col("least")).alias("a"), F.when(near, F.col("fp")).alias("b"), F.when(crowded, F.struct("part", "rest", "bit", "left")).alias("hot"))
    found = stored(found.distinct())
    star, hot = found.filter("a IS NOT NULL").select("a", "b"), found.filter("hot IS NOT NULL").select("hot.*")
    own = nodes.join(merged(components(star)), nodes.fp == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    own = _dealt(own, d)

    lists = hot.groupBy("part", "rest").agg(F.collect_set(F.struct("bit", "left")).alias("hot"))
    cold = _keyed(own.join(merged(lists), ["part", "rest"], "left"), d).filter(F.col("hot").isNull() | ~F.array_contains("hot", F.struct("bit", "left"))).drop("hot")
    cold = cold.select("*", F.min("root").over(same).alias("low"), F.max("root").over(same).alias("high")).filter("low < high")
    cold = cold.select("fp", "root", "bit", F.collect_list(F.struct("fp", "root")).over(same).alias("all"))

    def linked(x: Callable[[str], F.Column], y: Callable[[str], F.Column]) -> F.Column:
        diff = x("fp").bitwiseXOR(y("fp"))
        return (x("fp") < y("fp")) & (F.bit_count(diff) <= d) & (x("root") != y("root")) & _first(diff, x("bit"), d)

    pairs = cold.select(F.col("fp").alias("a"), F.explode(F.filter("all", lambda y: linked(F.col, y.getField))).alias("y")).select("a", F.col("y.fp").alias("b"))

    cut = F.inline(F.array(*[F.struct(F.lit(k).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(_slices(d))]))
    fine = own.join(merged(hot), ["part", "rest"]).filter(F.col("fp").bitwiseAND(_kept(F.col("bit"), d)) == F.col("left")).select("fp", "root", "bit", "left", cut)
    x, y = fine.alias("x"), fine.alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    first_slice = F.lit(-1)
    for k, m in reversed(list(enumerate(_slices(d)))):
        first_slice = F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(k)).otherwise(first_slice)
    equal = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("left", "bit", "n", "bits")]
    met = functools.reduce(operator.and_, [*equal, linked(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")), F.col("x.n") == first_slice])
    return star.union(pairs).union(x.join(merged(y), met).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest value reachable) of the nodes of edges ``a``, ``b``.

    Rounds go on until one changes nothing; their number grows with the
    logarithm of a component's size.  Edges with a null end are no links.  Joins
    merge: broadcasts of every round would add up in the driver.
    """
    edges = stored(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(merged(low), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(merged(low), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, edges = edges, stored(small.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", d: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    Null or wordless text has fingerprint zero, which links like any other.
    Rows that repeat an id are kept, each with its own fingerprint.  A null id
    is kept and never becomes a component's id unless no other id is there.
    An empty table gives an empty table.  Columns besides the two named are
    not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = stored(nodes)
    member = components(links(nodes.select("fp"), d))
    labelled = nodes.join(merged(member), nodes.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # stored, so that the join below can split a large class over tasks
    smallest = stored(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = labelled.join(merged(smallest), "root").select("fp", "component_id")
    return fps.join(merged(of_fp), "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
