"""Filters against combinations that were drawn before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import combos
from . import blocks


def unseen(candidates: DataFrame, draws: DataFrame, threshold: int = 6) -> DataFrame:
    """Candidates that share fewer than ``threshold`` numbers with every draw.

    Two combinations share that many numbers if they have a subset of that size
    in common, so candidates and draws meet by equality of subsets (of the whole
    combination at 6).  Subsets of the draws are made distinct first: there are
    few of the small sizes, and a frequent one is one row.
    """
    if not 1 <= threshold <= 6:
        raise ValueError("threshold outside 1..6")
    past = draws.filter("c IS NOT NULL").select("c").distinct()
    if threshold == 6:
        return candidates.join(past, "c", "left_anti")
    left, right = (df.select("c", F.explode(_subsets("c", threshold)).alias("k")) for df in (candidates.select("c").distinct(), past))
    return candidates.join(left.join(right.select("k").distinct(), "k", "left_semi").select("c").distinct(), "c", "left_anti")


def first_matches(candidates: DataFrame, draws: DataFrame, threshold: int) -> DataFrame:
    """Candidates (distinct ``c``) with ``first``, the position of the first draw that shares ``threshold`` numbers or more, and ``overlap``, how many it shares; nulls where none does.

    An index holds, for each subset of that size, the least position of the
    draws that have it: one row a subset, however often it was drawn.  A
    candidate's least position over its subsets is the first match, and its
    draw tells the overlap.
    """
    if not 1 <= threshold <= 6:
        raise ValueError("threshold outside 1..6")
    numbered = blocks.numbered(draws).filter("c IS NOT NULL").select("pos", "c")
    index = numbered.select("pos", F.explode(_subsets("c", threshold)).alias("k")).groupBy("k").agg(F.min("pos").alias("pos"))
    mine = candidates.select("c").distinct()
    first = mine.select("c", F.explode(_subsets("c", threshold)).alias("k")).join(index, "k").groupBy("c").agg(F.min("pos").alias("first"))
    found = first.join(numbered.select(F.col("pos").alias("first"), F.col("c").alias("drawn")), "first").select("c", "first", combos.overlap(F.col("c"), F.col("drawn")).alias("overlap"))
    return mine.join(found, "c", "left")


def with_reasons(candidates: DataFrame, draws: DataFrame, threshold: int) -> DataFrame:
    """``c``, ``passed``, ``reason`` (of those that do not pass: what was shared with the first draw that shares too much)."""
    rows = first_matches(candidates, draws, threshold)
    reason = F.format_string("shares %d numbers with an earlier draw, fewer than %d may be", F.col("overlap"), F.lit(threshold))
    return rows.select("c", F.col("first").isNull().alias("passed"), F.when(F.col("first").isNotNull(), reason).alias("reason"))


def _subsets(c: str, size: int) -> F.Column:
    """Keys of all subsets of ``size`` of the six numbers."""
    from itertools import combinations

    return F.array(*[F.concat_ws("-", *[F.col(c)[i] for i in which]) for which in combinations(range(6), size)])


def co_occurrence(draws: DataFrame) -> DataFrame:
    """``x``, ``y``, ``n``: how often each pair of numbers came together."""
    x = F.explode(F.col("c")).alias("x")
    pairs = draws.filter("c IS NOT NULL").select("c", x).select("x", F.explode("c").alias("y")).filter("x < y")
    return pairs.groupBy("x", "y").agg(F.count("*").alias("n"))


def rare_pairs(draws: DataFrame, k: int = 22) -> DataFrame:
    return co_occurrence(draws).orderBy("n", "x", "y").limit(k)
