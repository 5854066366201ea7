"""Draws numbered and dealt out in blocks of rounds, so that no statistic needs one task for all rounds.

Rounds are numbered by counting cells of round ids and adding up the counts
before each.  Numbered rows are dealt to blocks of consecutive positions, each
with a halo of the rows before it: trailing windows are then windows inside a
block.  What goes back to the first round is a sum inside the block and a carry,
the sum over the blocks before, of one row a block and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits of a cell (round ids) and of a block (positions).
CELL_BITS, BLOCK_BITS = 9, 8
NUMBERS = 45


def sums_before(totals: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, ``before``: the sum of ``value`` over smaller keys, each key once.

    Keys are packed by their higher digits; a pack has at most ``2 ** CELL_BITS``
    of them, and one row holds the packs' totals.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    packs = totals.groupBy(F.shiftright(key, CELL_BITS).alias("pack")).agg(pairs.alias("pairs"), F.sum(value).alias("total"))
    upto = lambda array, i, name: F.aggregate(F.slice(array, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x[name])
    row = packs.agg(F.array_sort(F.collect_list(F.struct("pack", "total"))).alias("all"))
    starts = row.select("all", F.posexplode("all").alias("i", "x")).select("x.pack", upto("all", F.col("i"), "total").alias("start"))
    each = packs.join(starts, "pack").select("start", "pairs", F.posexplode("pairs").alias("i", "x"))
    return each.select(F.col("x.k").alias(key), (F.col("start") + upto("pairs", F.col("i"), "v")).alias("before"))


def numbered(draws: DataFrame) -> DataFrame:
    """``pos`` (1 .. by round), ``round``, ``c``, ``bonus``, and one more row for the round to come.

    Rounds should differ; those that do not are numbered one after the other.
    """
    draws = draws.select(F.col("round").cast("long").alias("round"), "c", "bonus")
    cells = draws.groupBy(F.shiftright("round", CELL_BITS).alias("cell")).agg(F.count("*").alias("n"), F.max("round").alias("last"))
    coming = cells.agg((F.coalesce(F.max("last"), F.lit(0)) + 1).alias("round"), (F.coalesce(F.sum("n"), F.lit(0)) + 1).alias("pos"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("round"))
    rows = draws.withColumn("cell", F.shiftright("round", CELL_BITS)).join(sums_before(cells, "cell", "n"), "cell").withColumn("pos", F.col("before") + place)
    return rows.select("pos", "round", "c", "bonus").unionByName(coming.select("pos", "round", F.lit(None).cast("array<int>").alias("c"), F.lit(None).cast("int").alias("bonus")))


def dealt(rows: DataFrame, halo: int, bits: int = BLOCK_BITS) -> DataFrame:
    """Numbered rows by ``block`` with the ``halo`` rows before it (``own`` is false for these), and ``last`` and ``before``, the two draws before.

    ``last`` and ``before`` are right in rows that are the block's own.
    """
    at = F.col("pos") - 1
    block = F.explode(F.sequence(F.shiftright(at, bits), F.shiftright(at + max(halo, 2), bits)))
    out = rows.select("*", block.alias("block")).withColumn("own", F.col("block") == F.shiftright(at, bits))
    w = Window.partitionBy("block").orderBy("pos")
    return out.select("*", F.lag("c", 1).over(w).alias("last"), F.lag("c", 2).over(w).alias("before"))


def positions(draws: DataFrame) -> DataFrame:
    """Draws with ``pos``, ``last`` and ``before``, and one more row for the round to come."""
    return dealt(numbered(draws), 2).filter("own").select("pos", "round", "c", "bonus", "last", "before")


def holds(c: Column) -> Column:
    """0/1 for each number: whether the combination has it."""
    return F.transform(F.sequence(F.lit(1), F.lit(NUMBERS)), lambda n: F.coalesce(F.array_contains(c, n), F.lit(False)).cast("int"))


def vector(each: str) -> Column:
    """An array with the SQL expression ``each`` for each number, ``#`` being its place from 0: one expression to send, not hundreds."""
    return F.expr(f"array({', '.join(each.replace('#', str(i)) for i in range(NUMBERS))})")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to as many tasks as the session has shuffle partitions.

    For groups of few bytes and much work: a shuffle that groups alone ask for
    is packed into few tasks by its bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder where one is set, else held by the executors: for what several jobs read."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    df = df.persist()
    df.count()
    return df
