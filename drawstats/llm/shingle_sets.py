"""Near-duplicate classes by the similarity of word-shingle sets: SimHash first, completed exactly.

Fingerprints of the sets meet by deletion-variant signatures (``simhash``), and
each node is compared with one that they find near.  Fingerprints miss most
pairs at the lower end of the similarity, so that the rest is found by keys:
two sets with a Jaccard similarity of at least ``t`` share one of the first
``n - ceil(t n) + 1`` members of each, in any order of all shingles.  Each node
is compared with the hub of its keys, which joins the copies of one text without
making all their pairs.  What is left are pairs of different components that
share a key; sizes, places, the number of members that the prefixes share and
tallies of the sets rule out most, and the full sets of the others are compared.  The order puts shingles last that are frequent
in a bounded sample: it saves pairs and has no part in the result.

Texts with equal sets are one node, so copies make no pairs.  Sets and shingles
are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RangeHash, merged, mixed, pieces, stored, text_buffer, trimmed, words_of
from .simhash import DISTANCE, _within, components, links, majority

#: Words of a shingle, and the least similarity of near duplicates as a fraction.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Texts that the sample for the order has, about; shingles that it keeps; in how many texts they are at least.
SAMPLED, ORDERED, OFTEN = 20_000, 1 << 16, 4
#: Parts of a set whose sizes bound what two sets have in common.
TALLIES = 64
#: Keys that a node carries into the join of pairs.
KEYS = 256
_STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def shingle_sets(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the shingles of the texts in a byte buffer, each pair once and in order; a shorter text is one shingle."""
    starts, ends, row = words_of(raw, off)
    word = RangeHash(LOWER[raw])(starts, ends)
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    made = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    begin, length = np.repeat(first, made) + _within(made), np.repeat(np.minimum(count, shingle), made)
    owner = np.repeat(np.arange(len(made)), made)
    h = np.zeros(len(begin), np.uint64)
    for k in range(shingle):
        inside = length > k
        h[inside] = mixed(h[inside] * _STEP + word[begin[inside] + k])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(values.view(np.int64)))


def _sets(docs: DataFrame, by: str) -> DataFrame:
    """``by`` and ``shingles`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                row, h = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(h, np.bincount(row, minlength=j - i))], names=[by, "shingles"])

    return docs.select(by, "text").mapInArrow(trimmed(run), f"{by} long, shingles array<long>")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that most texts of a sample have."""
    every = max(1, docs.count() // SAMPLED)
    h = F.xxhash64("text")
    sample = docs.filter(F.pmod(h, F.lit(every)) == 0).select(h.alias("h"), "text").dropDuplicates(["h"])
    got = _sets(sample, "h").select(F.explode("shingles").alias("s")).groupBy("s").count().filter(F.col("count") >= OFTEN)
    got = got.orderBy(F.desc("count"), "s").limit(ORDERED).toArrow()
    s, n = got["s"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefixed(docs: DataFrame) -> DataFrame:
    """``h1``, ``h2``, ``node`` (the set's hash), ``n`` (its size), ``fp`` (its fingerprint), ``tally`` (members in each of
    ``TALLIES`` parts) and ``prefix`` of each row of ``docs`` (``h1``, ``h2``, ``text``)."""
    often, times = _frequent(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(2))
            for i, j in pieces(off):
                row, h = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.bincount(row, minlength=j - i)
                first = np.cumsum(n) - n
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h ^ _SALT))))
                node = mixed(total[first + n] - total[first] + n.astype(np.uint64))
                fp = majority(h, n)
                tally = np.bincount(row * TALLIES + (h % np.uint64(TALLIES)).astype(np.int64), minlength=(j - i) * TALLIES)
                tally = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * TALLIES), pa.array(tally.astype(np.int32)))
                weight = np.zeros(len(h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    weight = np.where(often[at] == h, times[at], 0)
                h = h[np.lexsort((h, weight, row))]
                head = np.where(n > 0, n - -(-NUMERATOR * n // DENOMINATOR) + 1, 0)
                chosen = h[np.repeat(first, head) + _within(head)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(fp.view(np.int64)), tally, _lists(chosen, head)],
                    names=["h1", "h2", "node", "n", "fp", "tally", "prefix"],
                )

    return docs.select("h1", "h2", "text").mapInArrow(trimmed(run), "h1 long, h2 long, node long, n int, fp long, tally array<int>, prefix array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """``key``, ``node``, ``n``, ``at`` and ``weight`` of the prefix members that more than one node has.

    Members that the same nodes have, as those of a passage do, are one key;
    ``weight`` is their number and ``at`` the first place of one in the node's
    prefix.
    """
    flat = rows.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    # stored, so that the join can split a frequent key over tasks
    met = stored(flat.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key"))
    each = stored(flat.join(merged(met), "key", "left_semi").groupBy("key", "node").agg(F.first("n").alias("n"), F.first("at").alias("at")))
    who = each.groupBy("key").agg(F.xxhash64(F.bit_xor("node"), F.bit_xor(F.xxhash64("node")), F.count("*")).alias("who"))
    return each.join(merged(stored(who)), "key").groupBy(F.col("who").alias("key"), "node").agg(F.first("n").alias("n"), F.min("at").alias("at"), F.count("*").alias("weight"))


def fingerprint_pairs(nodes: DataFrame, d: int = DISTANCE) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes (``node``, ``fp``) that ``simhash.links`` finds at most ``d`` bits apart; at most one for each ``b``."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead")))
    same = nodes.join(merged(heads), "fp").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    apart = links(heads.select("fp"), d)
    for side in ("a", "b"):
        apart = apart.join(merged(heads.select(F.col("fp").alias(side), F.col("lead").alias(f"lead_{side}"))), side)
    return same.union(apart.groupBy(F.col("lead_b").alias("b")).agg(F.min("lead_a").alias("a")).select("a", "b"))


def hub_pairs(each: DataFrame) -> DataFrame:
    """A pair ``a``, ``b`` for each node ``b``: ``a`` is the hub that it shares most keys with.  The hub of a key is its node with most shared keys."""
    degree = stored(each.groupBy("node").agg(F.sum("weight").alias("degree")))
    hubs = stored(each.join(merged(degree), "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub")).select("key", F.col("hub.node").alias("a")))
    met = each.join(merged(hubs), "key").filter("node <> a").groupBy(F.col("node").alias("b"), "a").agg(F.sum("weight").alias("k"))
    return met.groupBy("b").agg(F.max(F.struct("k", "a")).alias("x")).select("x.a", "b")


def _enough(common: F.Column, both: F.Column) -> F.Column:
    """Whether ``common`` members in common make sets with ``both`` members together similar."""
    return (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * both


def _head(n: F.Column) -> F.Column:
    """Members of the prefix of a set of ``n``."""
    return n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1


def candidates(each: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes of different components (``node``, ``root``) that may be similar; each once.

    A pair is made under the first key that both have, if the prefixes have
    enough in common: what else is common lies behind one of the prefixes, so
    that it is no more than that set's rest.  A node of more than ``KEYS`` keys
    does not carry them; its pairs are made under each key and then once.
    """
    own = each.join(merged(roots), "node", "left").select("key", "node", "n", "at", "weight", F.coalesce("root", "node").alias("root"))
    own = stored(own)
    mixed_keys = stored(own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"))
    own = stored(own.join(merged(mixed_keys), "key", "left_semi"))
    lists = F.array_sort(F.collect_list(F.struct("key", "weight")))
    carried = own.groupBy("node").agg(F.count("*").alias("k"), lists.alias("l")).filter(F.col("k") <= KEYS)
    own = own.join(merged(carried.select("node", F.col("l.key").alias("keys"), F.col("l.weight").alias("weights"))), "node", "left")
    x, y = own.alias("x"), own.alias("y")
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # of members in common, if this is the first
    both = F.array_intersect("x.keys", "y.keys")
    shared = F.aggregate(both, F.lit(0).cast("long"), lambda s, k: s + F.element_at("x.weights", F.array_position("x.keys", k).cast("int")))
    rest = F.greatest(F.col("x.n") - _head(F.col("x.n")), F.col("y.n") - _head(F.col("y.n")))
    total = F.col("x.n") + F.col("y.n")
    once = F.coalesce((F.array_min(both) == F.col("x.key")) & _enough(shared + rest, total), F.lit(True))
    pairs = x.join(merged(y), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _enough(most, total) & once)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _joined(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """``pairs`` with ``value`` of both nodes as ``x`` and ``y``."""
    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(merged(sets.select(F.col("node").alias(side), F.col(value).alias(name))), side)
    return pairs


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of ``nodes`` whose sets have the similarity: first those are ruled out whose tallies differ
    too much, then the sets of the others are made and compared."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda t, u: t + u)
    x, y = F.col("x"), F.col("y")
    least = total(F.zip_with("x", "y", lambda u, v: F.least(u, v)))
    left = stored(_joined(pairs, nodes, "tally").filter(_enough(least, total(x) + total(y))).select("a", "b"))
    ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.join(merged(nodes.join(merged(ends), "node", "left_semi").select("node", "h1", "h2")), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    sets = stored(_sets(texts, "node"))
    return _joined(left, sets, "shingles").filter(_enough(F.size(F.array_intersect(x, y)), F.size(x) + F.size(y))).select("a", "b")


def near_classes(docs: DataFrame) -> DataFrame:
    """``h1``, ``h2`` and ``root`` (a value that all rows of a class have) for each row of ``docs`` (``h1``, ``h2``, ``text``).

    ``h1`` and ``h2`` tell rows of different texts apart.  A class is a
    component of the pairs whose sets have at least the similarity; texts
    without a word are one class.  First each node is compared with one that
    its fingerprint is near, and with one hub of its keys; then all pairs of
    different components that share a key are.
    """
    rows = stored(prefixed(docs))
    one = F.min(F.struct("h1", "h2", "fp", "tally")).alias("x")
    nodes = stored(rows.groupBy("node").agg(one).select("node", "x.*"))
    each = stored(shared_keys(rows.select("node", "n", "prefix")))
    first = fingerprint_pairs(nodes.select("node", "fp")).union(hub_pairs(each)).distinct()
    edges = stored(similar(first, nodes, docs))
    more = similar(candidates(each, components(edges)), nodes, docs)
    roots = components(edges.union(more))
    return rows.join(merged(roots), "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
