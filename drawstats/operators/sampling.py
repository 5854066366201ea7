"""Weighted combinations without replacement, by the Gumbel trick with keyed uniform numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import combos

#: Keeps some rows of a table of samples.
Filter = Callable[[DataFrame], DataFrame]


def gumbel_top6(p: Column, number: Column, *parts: Column) -> Column:
    """What to order numbers by (largest first): log-weight and Gumbel noise; null weight never wins."""
    return F.log(p) - F.log(-F.log(combos.uniform(*parts, number)))


def samples(probabilities: DataFrame, n: int, seed: int | Column = 42, by: list[str] | None = None, start: int = 0) -> DataFrame:
    """``n`` combinations for each group of ``by`` (a round, or nothing): ``by``, ``sample_id``, ``c`` (sorted).

    ``probabilities`` has ``number`` and ``p``, 45 rows a group.  They become
    one array a group, so samples are made row by row without a shuffle and the
    same whatever the partitioning; sequential draws without replacement have
    the same distribution.
    """
    by = by or []
    if "p" not in probabilities.columns or "number" not in probabilities.columns:
        raise ValueError("probabilities need the columns number and p")
    spark = probabilities.sparkSession
    table = probabilities.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("number", "p"))).alias("ps")) if by else probabilities.agg(
        F.array_sort(F.collect_list(F.struct("number", "p"))).alias("ps")
    )
    seed = F.lit(seed) if isinstance(seed, int) else seed
    ids = spark.range(start, start + n).withColumnRenamed("id", "sample_id")
    # one side has a row a group of 45 numbers; without groups that is one row
    both = ids.crossJoin(F.broadcast(table)) if not by else table.select("*", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + n - 1).cast("long"))).alias("sample_id"))
    keyed = F.transform(F.filter("ps", lambda x: x.p > 0), lambda x: F.struct((-gumbel_top6(x.p, x.number, seed, F.col("sample_id"))).alias("k"), x.number.alias("number")))
    best = F.slice(F.array_sort(keyed), 1, combos.PICK)
    return both.select(*by, "sample_id", once(F.array_sort(F.transform(best, lambda x: x.number))).alias("c"))


#: What stands behind the digits of a number, as text: letters that fall, so that of equal digits the smaller number is larger.
_LAST = 109


def equal_samples(groups: DataFrame, n: int, seed: int | Column = 42, start: int = 0) -> DataFrame:
    """``groups`` with ``n`` combinations of equally likely numbers for each row, ``sample_id`` and ``c`` (sorted): those of ``samples`` with 45 equal weights.

    With equal weights the noise's order is that of the uniform numbers, so their
    digits are sorted as they are, without logarithms.  Few bytes of rows make
    much work: deal them out before (``blocks.spread``).
    """
    each = groups.select("*", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + n - 1).cast("long"))).alias("sample_id"))
    seed = F.lit(seed) if isinstance(seed, int) else seed
    each = each.select("*", once(combos.joined(seed, F.col("sample_id"), F.lit(""))).alias("_keyed"))
    numbers = F.array(*[F.struct(F.lit(str(k)).alias("text"), F.lit(chr(_LAST - k)).alias("letter")) for k in range(1, combos.NUMBERS + 1)])
    best = F.slice(F.sort_array(F.transform(numbers, lambda x: F.concat(combos.digest(F.concat("_keyed", x.text)), x.letter)), asc=False), 1, combos.PICK)
    return each.select(*groups.columns, "sample_id", once(F.sort_array(F.transform(best, lambda x: _LAST - F.ascii(F.substring(x, -1, 1))))).alias("c"))


def once(column: Column) -> Column:
    """The column behind a generator, so that a filter that names it many times does not compute it as often."""
    return F.explode(F.array(column))


def uniform_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1, 46).select(F.col("id").cast("int").alias("number"), F.lit(1.0 / 45).alias("p"))


def accepted(candidates: DataFrame, passes: Column, most: int) -> DataFrame:
    """The first ``most`` distinct combinations, by sample, that pass."""
    return candidates.filter(passes).groupBy("c").agg(F.min("sample_id").alias("sample_id")).orderBy("sample_id").limit(most)


def rejection(candidates: DataFrame, passes: Column, relaxed: Column, games: int, target: int) -> DataFrame:
    """Accepted combinations of a given table; if there are fewer than ``games``, those of the relaxed predicate after them."""
    strict = accepted(candidates, passes, target).withColumn("phase", F.lit(0))
    found = strict.agg(F.count("*").alias("found"))
    more = accepted(candidates, relaxed, target).withColumn("phase", F.lit(1)).crossJoin(F.broadcast(found)).filter(F.col("found") < games).drop("found")
    more = more.join(strict.select("c"), "c", "left_anti")
    return strict.unionByName(more)


#: The first batch of an adaptive run, how much more than the measured rate asks for is drawn, and how much larger a batch may be than the one before.
FIRST_BATCH, SPARE, GROWTH = 2000, 1.2, 8
#: Candidates wanted in all and a game, and the limits of the relaxed phase.
LEAST_TARGET, TARGET_PER_GAME, RELAXED_PER_GAME, LEAST_RELAXED, RELAXED_SHARE = 350, 70, 8, 6000, 0.35


@dataclass(frozen=True)
class Run:
    """``rows`` (``c``, ``sample_id``, ``phase``: 0 strict, 1 relaxed) of an adaptive run, how many samples were looked at, and the batches that were drawn."""

    rows: DataFrame
    attempts: int
    batches: list[int]


def _until(probabilities: DataFrame, passes: Filter, seed: int, start: int, most: int, target: int, got: list[Row]) -> tuple[int, list[int]]:
    """Adds to ``got`` what passes among the samples from ``start`` on, until it has ``target`` rows or ``most`` samples were drawn; the samples looked at, and the batches.

    A sample's noise is keyed by its number, so what is accepted does not depend
    on the batches; the size of the next one follows from the share accepted.
    """
    spark, drawn, batches, size = probabilities.sparkSession, 0, [], FIRST_BATCH
    while drawn < most and len(got) < target:
        size = min(size, most - drawn)
        rows = passes(samples(probabilities, size, seed, start=start + drawn)).groupBy("c").agg(F.min("sample_id").alias("sample_id"))
        if got:  # at most target rows
            rows = rows.join(F.broadcast(spark.createDataFrame([(r.c,) for r in got], "c array<int>")), "c", "left_anti")
        new = rows.orderBy("sample_id").limit(target - len(got)).collect()
        got += new
        drawn += size
        batches.append(size)
        wanted = SPARE * (target - len(got)) * size / max(len(new), 1)
        size = int(min(max(wanted, FIRST_BATCH), GROWTH * size))
    return (got[-1].sample_id + 1 - start if len(got) >= target else drawn), batches


def adaptive(probabilities: DataFrame, passes: Filter, relaxed: Filter, games: int, max_attempts: int, seed: int = 42, target: int | None = None) -> Run:
    """Rejection sampling from one table of 45 probabilities, in batches that follow the acceptance rate.

    ``passes`` keeps the good rows of samples (``sample_id``, ``c``).  Distinct
    combinations are accepted in the order of samples until there are ``target``
    (350, and 70 a game at least), or ``max_attempts`` were drawn.  If there are
    fewer than ``games`` then, more samples are drawn that pass ``relaxed``
    only, until there are eight a game or a third of the attempts again (6 000
    at least) are spent.  The driver holds the accepted ones, ``target`` at most.
    """
    if games <= 0 or max_attempts <= 0:
        raise ValueError("games and max_attempts must be positive")
    spark, got = probabilities.sparkSession, []
    attempts, batches = _until(probabilities, passes, seed, 0, max_attempts, target or max(LEAST_TARGET, TARGET_PER_GAME * games), got)
    strict = len(got)
    if strict < games:
        more, further = _until(probabilities, relaxed, seed, max_attempts, max(LEAST_RELAXED, int(max_attempts * RELAXED_SHARE)), RELAXED_PER_GAME * games, got)
        attempts, batches = attempts + more, batches + further
    rows = [(r.c, r.sample_id, int(i >= strict)) for i, r in enumerate(got)]
    return Run(spark.createDataFrame(rows, "c array<int>, sample_id long, phase int"), attempts, batches)


def without(candidates: DataFrame, shown: DataFrame) -> DataFrame:
    """Candidates whose key is not among ``shown.k``, the keys of results that were given lately."""
    return candidates.withColumn("k", combos.key(F.col("c"))).join(shown.select("k").distinct(), "k", "left_anti").drop("k")


def number_shares(combinations: DataFrame) -> DataFrame:
    """``number``, ``p``: how often each number is in the combinations, over all; equal shares if there are none."""
    spark = combinations.sparkSession
    n = combinations.select(F.explode("c").alias("number")).groupBy("number").agg(F.count("*").alias("n"))
    every = spark.range(1, 46).select(F.col("id").cast("int").alias("number")).join(n, "number", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    from .scores import shares

    return every.select("number", shares(F.col("n"), []).alias("p"))


def blended(base: DataFrame, filtered: DataFrame, weight: float = 0.65) -> DataFrame:
    from .scores import shares

    both = base.select("number", F.col("p").alias("x")).join(filtered.select("number", F.col("p").alias("y")), "number")
    both = both.withColumn("b", F.greatest(F.lit(0.0), weight * F.col("x") + (1 - weight) * F.col("y")))
    return both.select("number", shares(F.col("b"), []).alias("p"))
