"""Scores, ranks, diversity and percentiles of combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import combos
from . import blocks


def scored(combinations: DataFrame, scores: DataFrame) -> DataFrame:
    """``combinations`` with ``combo_score``, the sum of its numbers' ``score`` (0 where a number has none).

    ``scores`` is a table of at most 45 numbers; it becomes one map.
    """
    m = scores.agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("_m"))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + F.coalesce(F.col("_m")[x], F.lit(0.0)))
    return combinations.crossJoin(F.broadcast(m)).withColumn("combo_score", total).drop("_m")


def distinct_first(combinations: DataFrame) -> DataFrame:
    """Distinct combinations, with their first sample."""
    rest = [c for c in combinations.columns if c not in ("c", "sample_id")]
    return combinations.groupBy("c", *rest).agg(F.min("sample_id").alias("sample_id"))


#: Cells of the score in which ranks are counted, a unit of score.
CELLS = 256


def ranked(combinations: DataFrame, top_k: int | None = None) -> DataFrame:
    """With ``rank`` by falling score, earlier samples first; only the first ``top_k`` if given (no full sort then).

    Without ``top_k`` rows are numbered in cells of the score, and the sizes of
    the cells before are added, so that no task sees all rows.
    """
    order = [F.desc("combo_score"), F.asc("sample_id")]
    if top_k:
        return combinations.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top_k rows
    rows = combinations.withColumn("_cell", F.floor(-F.coalesce("combo_score", F.lit(0.0)) * CELLS))
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    rows = rows.join(blocks.sums_before(sizes, "_cell", "_n"), "_cell")
    return rows.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("_cell").orderBy(*order))).drop("_cell", "before")


def diverse(ranked_rows: DataFrame, count: int, max_overlap: int, by: list[str] | None = None) -> DataFrame:
    """Greedy choice in rank order: distinct, and at most ``max_overlap`` numbers shared with any chosen before.

    ``by``, ``chosen`` (an array of combinations).  The choice folds over all
    ranks of a group in one row: for ranks that ``top_k`` bounds.  ``diverse_in_blocks``
    is for any number of ranks.
    """
    by = by or []
    rows = ranked_rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("r"))
    return rows.select(*by, fold_diverse(F.transform("r", lambda x: x.c), count, max_overlap).alias("chosen"))


#: Ranks in the first block of a choice, and how many times larger each next one is (at most ``LARGEST``).
FIRST_BLOCK, WIDER, LARGEST = 1024, 4, 1 << 16


def choose(ranked_rows: DataFrame, count: int, max_overlap: int) -> list[list[int]]:
    """The greedy choice over blocks of ranks: what a block adds is found beside what was chosen before, and the next one is read only if it is needed.

    Candidates that share too much with the chosen are left out where they are,
    so a row holds at most one block of the others, and the driver the chosen.
    """
    if count <= 0:
        raise ValueError("count must be positive")
    chosen: list[list[int]] = []
    last, width = 0, FIRST_BLOCK
    end = None
    while len(chosen) < count:
        have = F.array(*[F.array(*[F.lit(x) for x in c]) for c in chosen]).cast("array<array<int>>")
        block = ranked_rows.filter((F.col("rank") > last) & (F.col("rank") <= last + width))
        near = F.exists(have, lambda g: (combos.overlap(g, F.col("c")) > max_overlap) | (g == F.col("c"))) if chosen else F.lit(False)
        got = block.filter(~near).agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("r")).select(fold_diverse(F.transform("r", lambda x: x.c), count - len(chosen), max_overlap).alias("x")).first()
        chosen += [list(c) for c in got.x]
        last, width = last + width, min(width * WIDER, LARGEST)
        if len(chosen) < count:
            end = ranked_rows.agg(F.max("rank")).first()[0] or 0 if end is None else end
            if last >= end:
                break
    return chosen


def diverse_in_blocks(ranked_rows: DataFrame, count: int, max_overlap: int) -> DataFrame:
    """``chosen``: one row with the choice over any number of ranks (``choose``; of a table that is kept, several jobs read it)."""
    return ranked_rows.sparkSession.createDataFrame([(choose(ranked_rows, count, max_overlap),)], "chosen array<array<int>>")


def fold_diverse(ordered: Column, count: int, max_overlap: int) -> Column:
    return F.aggregate(
        ordered, F.array().cast("array<array<int>>"),
        lambda got, c: F.when((F.size(got) < count) & ~F.exists(got, lambda g: (combos.overlap(g, c) > max_overlap) | (g == c)), F.concat(got, F.array(c))).otherwise(got),
    )


def relaxed_diverse(ranked_rows: DataFrame, count: int, first: int = 3, last: int = 6) -> DataFrame:
    """The choice at the first overlap, from ``first`` on, that gives enough, over blocks of ranks; ``chosen``, ``max_overlap``."""
    for k in range(first, last + 1):
        chosen = choose(ranked_rows, count, k)
        if len(chosen) >= count:
            break
    return ranked_rows.sparkSession.createDataFrame([(chosen, k)], "chosen array<array<int>>, max_overlap int")


def filled(chosen: DataFrame, ranked_rows: DataFrame, count: int) -> DataFrame:
    """Chosen combinations and, if they are too few, the best others: ``c``, ``place``."""
    first = chosen.select(F.posexplode("chosen").alias("i", "c")).select("c", F.lit(0).alias("part"), F.col("i").cast("long").alias("at"))
    others = ranked_rows.join(first.select("c"), "c", "left_anti").groupBy("c").agg(F.min("rank").alias("at")).orderBy("at").limit(count)
    both = first.union(others.select("c", F.lit(1).alias("part"), F.col("at").cast("long")))
    return both.withColumn("place", F.row_number().over(Window.orderBy("part", "at"))).filter(F.col("place") <= count).select("c", "place")


def percentile(selected: DataFrame, ranked_rows: DataFrame, bias: int = 0) -> DataFrame:
    """``percentile``: the mean of the ranks of the selected in hundredths of all ranks, moved by ``bias``, within 1 to 100."""
    total = ranked_rows.agg(F.count("*").alias("n"))
    last = ranked_rows.groupBy("c").agg(F.max("rank").alias("rank"))  # of repeated combinations the last rank holds
    each = selected.join(last, "c").crossJoin(F.broadcast(total)).select(F.least(F.lit(100.0), F.greatest(F.lit(1.0), F.bround(100.0 * F.col("rank") / F.col("n")))).alias("x"))
    value = F.least(F.lit(100.0), F.greatest(F.lit(1.0), F.bround(F.avg("x")) + bias))
    return each.agg(F.when(F.count("x") > 0, value).cast("int").alias("percentile"))


def top_numbers(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "number").limit(k)


def with_number_rank(scores: DataFrame, by: list[str]) -> DataFrame:
    """With ``rn``: rank by falling score, smaller numbers first."""
    return scores.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "number")))


def hit_metrics(ranked_numbers: DataFrame, by: list[str], ks: tuple[int, ...] = (15, 20)) -> DataFrame:
    """Per round: ``hit_<k>`` and ``mean_rank`` of the drawn numbers (22.5 if none)."""
    drawn = F.col("label") == 1
    return ranked_numbers.groupBy(*by).agg(
        *[F.sum(F.when(drawn & (F.col("rn") <= k), 1).otherwise(0)).alias(f"hit_{k}") for k in ks], F.coalesce(F.avg(F.when(drawn, F.col("rn"))), F.lit(22.5)).alias("mean_rank")
    )


def worker_tags(tagged: DataFrame) -> DataFrame:
    """Of each combination (``sample_id``, ``tags`` of all its numbers) the three most frequent tags, then by name; ``pattern`` if none."""
    n = tagged.select("sample_id", F.explode_outer("tags").alias("tag")).groupBy("sample_id", "tag").agg(F.count("*").alias("n"))
    named = n.filter("tag IS NOT NULL").groupBy("sample_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "tag"))), lambda x: x.tag), 1, 3).alias("t"))
    return tagged.select("sample_id").distinct().join(named, "sample_id", "left").select("sample_id", F.coalesce("t", F.array(F.lit("pattern"))).alias("tags"))
