"""As-of statistics of every number before every round, and the scores and features made of them.

``grid`` has a row for each round (and the one to come) and number.  Frames end
before the row, so nothing of a round is seen in its own statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import blocks, hmm, tallies
from .blocks import positions

RECENT, HOT_ROWS, HOT_FROM, COLD_ROWS, EXCESS_ROWS = 50, 5, 2, 10, 20
#: Weights of the scores where none are given.
WEIGHTS = {"hot": 0.4, "cold": 0.15, "neighbor": 0.3, "carryover": 0.4, "reverse": 0.1, "poisson": 0.5, "markov": 0.3}
#: Production weights without penalties.
SERVING = WEIGHTS | {"poisson": 0.0, "markov": 0.0}
MAX_PENALTY = 0.5


def grid(draws: DataFrame, halo: int = RECENT, extra: DataFrame | None = None, carries: DataFrame | None = None, since: DataFrame | None = None) -> DataFrame:
    """``pos``, ``round``, ``number``, ``a`` (drawn), ``carryover``, ``earlier`` (drawn in the last round, in the one before), ``neighbor``,
    ``reverse``, by ``block`` with the ``halo`` rows before it (not ``own``); ``upto`` counts how often the number was drawn in these, up to the row.

    Only rounds are shuffled, by block; the 45 numbers are made after, with
    what concerns each, so that windows sort no array.  ``extra`` has arrays
    over the numbers by ``pos``, ``carries`` by ``block``; with ``since`` (one
    row) only positions from there on are own.
    """
    rows = blocks.numbered(draws)
    if since is not None:
        rows = rows.crossJoin(F.broadcast(since)).filter(F.col("pos") >= F.col("since") - max(halo, 2)).drop("since")
    names = [c for c in extra.columns if c != "pos"] if extra is not None else []
    rows = blocks.dealt(rows if extra is None else rows.join(extra, "pos", "left"), halo)
    if since is not None:
        rows = rows.crossJoin(F.broadcast(since)).withColumn("own", F.col("own") & (F.col("pos") >= F.col("since")))
    if carries is not None:
        names += [c for c in carries.columns if c != "block"]
        rows = rows.join(carries, "block", "left")
    each = rows.select("block", "own", "pos", "round", "last", "before", "c", *names, F.explode(F.sequence(F.lit(1), F.lit(45))).alias("number"))
    has = lambda array, x: F.coalesce(F.array_contains(array, x), F.lit(False))
    n = F.col("number")
    carry = has("last", n)
    each = each.select(
        "block", "own", "pos", "round", "number", has("c", n).cast("int").alias("a"), carry.cast("int").alias("carryover"), has("before", n).cast("int").alias("earlier"),
        ((has("last", n - 1) | has("last", n + 1)) & ~carry).cast("int").alias("neighbor"), has("last", 46 - n).cast("int").alias("reverse"), *[F.get(c, n - 1).alias(c) for c in names],
    )
    return each.withColumn("upto", F.sum("a").over(in_block().rowsBetween(Window.unboundedPreceding, 0)))


def in_block() -> WindowSpec:
    """The rows of a number in a block, in order."""
    return Window.partitionBy("block", "number").orderBy("pos")


def seen(k: int) -> Column:
    """How often the number was drawn in the ``k`` rounds before; the halo must have as many.

    It is the difference of two counts, so a row costs the same whatever ``k`` is.
    """
    upto = lambda i: F.coalesce(F.lag("upto", i).over(in_block()), F.lit(0))
    return upto(1) - upto(k + 1)


def n_rows(k: int) -> Column:
    return F.least(F.lit(k).cast("long"), F.col("pos") - 1)


def posterior(alpha: Column | float, beta: Column | float, successes: Column, n: Column) -> tuple[Column, Column]:
    """Parameters of the beta posterior; null where 0 <= successes <= n, n > 0 does not hold."""
    ok = (successes >= 0) & (n > 0) & (successes <= n)
    return F.when(ok, alpha + successes), F.when(ok, beta + n - successes)


def flags(g: DataFrame, recent: int = RECENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """The grid's own rows with ``base``, the 0/1 flags and the ``excess`` over the expected count; no shuffle of the grid."""
    out = g.select(
        "pos", "round", "number", "a",
        ((1 + seen(recent)) / (2 + n_rows(recent))).alias("base"),
        (seen(HOT_ROWS) >= HOT_FROM).cast("int").alias("hot"),
        ((seen(COLD_ROWS) == 0) & (F.col("pos") > 1)).cast("int").alias("cold"),
        "carryover", (F.col("earlier") * (1 - F.col("carryover"))).alias("carryover2"), "neighbor", "reverse",
        F.greatest(F.lit(0.0), seen(EXCESS_ROWS) - n_rows(EXCESS_ROWS) * 6 / F.lit(45.0)).alias("excess"), "own", *keep,
    )
    return out.filter("own").drop("own")


def transitions(draws: DataFrame) -> DataFrame:
    """``prev``, ``curr``, ``n``, ``p``: how often each number was followed by each in the next draw; 0 where never."""
    pairs = positions(draws).filter("c IS NOT NULL AND last IS NOT NULL").select(F.explode("last").alias("prev"), "c").select("prev", F.explode("c").alias("curr"))
    n = pairs.groupBy("prev", "curr").agg(F.count("*").alias("n"))
    numbers = draws.sparkSession.range(1, 46).select(F.col("id").cast("int").alias("curr"))
    every = numbers.select(F.col("curr").alias("prev")).crossJoin(numbers)  # 45 by 45
    n = every.join(n, ["prev", "curr"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = F.sum("n").over(Window.partitionBy("prev"))
    return n.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def followers(draws: DataFrame, tail: int | None = None) -> DataFrame:
    """``pos``, ``m``: for each number the mean share, over the last draw's numbers, of transitions to it before ``pos``
    (of those within the last ``tail`` draws, if given).

    What followed each number is a 45 by 45 table that goes from round to round
    inside blocks of rounds; a block begins with what those before it counted.
    """
    return tallies.followers(blocks.numbered(draws), tail)


def markov(draws: DataFrame, tail: int | None = None) -> DataFrame:
    """``pos``, ``number``, ``markov``: the rows of ``followers``."""
    return followers(draws, tail).select("pos", F.posexplode("m").alias("at", "markov")).select("pos", (F.col("at") + 1).alias("number"), "markov")


def latest(draws: DataFrame, recent: int = RECENT, history: int = 100) -> DataFrame:
    """``statistics`` of the round to come alone, 45 rows, with ``shown`` (0/1 of the last ``history`` draws, oldest first).

    It needs the last draws and the transitions from the last one, and no window
    over the grid.
    """
    rounds = positions(draws)
    near = rounds.orderBy(F.desc("pos")).limit(max(recent, history) + 1).agg(F.array_sort(F.collect_list(F.struct("pos", "round", "c"))).alias("r")).filter(F.size("r") > 0)
    one = near.select(
        F.element_at("r", -1).pos.alias("pos"), F.element_at("r", -1).round.alias("round"), F.transform(F.slice("r", 1, F.size("r") - 1), lambda x: x.c).alias("h")
    ).withColumns({"last": F.try_element_at("h", F.lit(-1)), "before": F.try_element_at("h", F.lit(-2))})
    # one row
    moved = rounds.filter("c IS NOT NULL AND last IS NOT NULL").select("c", F.col("last").alias("from")).crossJoin(F.broadcast(one.select(F.col("last").alias("to"))))
    moved = moved.select(F.explode(F.array_intersect("from", "to")).alias("prev"), "c").groupBy("prev").agg(F.sum(F.size("c")).alias("total"), blocks.vector("sum(CAST(array_contains(c, # + 1) AS INT))").alias("f"))
    shares = moved.agg(blocks.vector("coalesce(sum(f[#] / total) / 6, 0D)").alias("m"))
    n = F.col("number")
    grid = one.crossJoin(F.broadcast(shares)).select("*", F.explode(F.sequence(F.lit(1), F.lit(45))).alias("number"))
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    tail = lambda k: F.when(F.size("shown") > k, F.slice("shown", -k, k)).otherwise(F.col("shown"))
    count = lambda k: F.aggregate(tail(k), F.lit(0), lambda a, x: a + x)
    size = lambda k: F.least(F.size("shown"), F.lit(k))
    carry = has("last", n)
    grid = grid.withColumn("shown", F.transform("h", lambda c: F.array_contains(c, n).cast("int")))
    return grid.select(
        "pos", "round", "number", F.lit(0).alias("a"), "last",
        ((1 + count(recent)) / (2 + size(recent))).alias("base"),
        (count(HOT_ROWS) >= HOT_FROM).cast("int").alias("hot"), ((count(COLD_ROWS) == 0) & (F.col("pos") > 1)).cast("int").alias("cold"),
        carry.cast("int").alias("carryover"), (has("before", n) & ~carry).cast("int").alias("carryover2"),
        ((has("last", n - 1) | has("last", n + 1)) & ~carry).cast("int").alias("neighbor"), has("last", 46 - n).cast("int").alias("reverse"),
        F.greatest(F.lit(0.0), count(EXCESS_ROWS) - size(EXCESS_ROWS) * 6 / F.lit(45.0)).alias("excess"), F.element_at("m", n).alias("markov"), tail(history).alias("shown"),
    )


def statistics(draws: DataFrame, recent: int = RECENT, tail: int | None = None, start_round: int | None = None) -> DataFrame:
    """``flags`` with ``markov`` (of the last ``tail`` draws, if given; 0 where fewer than two draws are known) and the ``block`` that rows lie by.

    From ``start_round`` on, if given: earlier rounds are then counted, but have no rows.
    """
    halo, since = max(recent, EXCESS_ROWS), None
    if start_round is not None:  # one row; without such a round no position is as large
        since = blocks.numbered(draws).filter(F.col("round") >= start_round).agg(F.coalesce(F.min("pos"), F.lit((1 << 62) - 1)).alias("since"))
    out = flags(grid(draws, halo, tallies.followers(blocks.numbered(draws), tail, since), since=since), recent, ("m", "block"))
    return out.withColumn("markov", F.coalesce("m", F.lit(0.0))).drop("m")


def boost(w: dict[str, float] | None = None) -> Column:
    """Sum of weights of the set flags."""
    w = w or WEIGHTS
    return F.col("hot") * w["hot"] + F.col("cold") * w["cold"] + (F.col("carryover") + F.col("carryover2")) * w["carryover"] + F.col("neighbor") * w["neighbor"] + F.col("reverse") * w["reverse"]


def score(w: dict[str, float] | None = None, min_score: float = 0.0) -> Column:
    """Base and boosts less penalties, at least ``min_score``."""
    w = w or WEIGHTS
    for name in ("poisson", "markov"):
        if not 0 <= w[name] <= MAX_PENALTY:
            raise ValueError(f"{name} outside 0..{MAX_PENALTY}")
    return F.greatest(F.lit(min_score), F.col("base") + boost(w) - F.col("excess") * w["poisson"] - F.col("markov") * w["markov"])


def tags() -> Column:
    names = ("hot", "cold", "carryover", "carryover2", "neighbor", "reverse")
    return F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]), lambda x: x.isNotNull())


def ensemble(base: DataFrame, boosts: DataFrame, penalties: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Scores by ``number`` from three tables (``number``, ``value``); what one lacks is zero."""
    out = None
    for name, df in (("b", base), ("u", boosts), ("p", penalties)):
        df = df.select("number", F.col("value").alias(name))
        out = df if out is None else out.join(df, "number", "full_outer")
    return out.select("number", F.greatest(F.lit(min_score), F.coalesce("b", F.lit(0.0)) + F.coalesce("u", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))).alias("score"))


def shares(x: Column, by: list[str]) -> Column:
    """``x`` over its sum in the group; equal shares where the sum is not positive."""
    w = Window.partitionBy(*by)
    total = F.sum(x).over(w)
    return F.when(total > 0, x / total).otherwise(1.0 / F.count("*").over(w))


def softmax(x: Column, temperature: float, by: list[str]) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    w = Window.partitionBy(*by)
    return F.exp((x - F.max(x).over(w)) / temperature)  # divide by its sum with ``shares``


def floored(p: Column, floor: float, n: int = 45) -> Column:
    """Shares moved so that each is at least ``floor``."""
    if floor < 0 or floor * n >= 1:
        raise ValueError("the floor leaves nothing to share")
    return floor + (1 - floor * n) * p


def probabilities(scores: DataFrame, temperature: float, floor: float, by: list[str], column: str = "score") -> DataFrame:
    """``scores`` with ``p``: softmax, and a floor if it is positive."""
    out = scores.withColumn("_e", softmax(F.col(column), temperature, by)).withColumn("p", shares(F.col("_e"), by)).drop("_e")
    return out.withColumn("p", floored(F.col("p"), floor)) if floor > 0 else out


def number_report(latest_rows: DataFrame, weights: dict[str, float], temperature: float, floor: float) -> DataFrame:
    """Components, total and probability of every number for the round to come, best first."""
    w = weights
    rows = probabilities(latest_rows.withColumn("score", score(w)), temperature, floor, [])
    part = lambda c, k: (F.col(c) * w[k]).alias(c)
    return rows.select(
        "number", "base", part("hot", "hot"), part("cold", "cold"), part("neighbor", "neighbor"), part("carryover", "carryover"), part("reverse", "reverse"),
        (F.col("excess") * w["poisson"]).alias("poisson"), part("markov", "markov"), "score", "p",
    ).orderBy(F.desc("score"), "number")


def next_round(stats: DataFrame) -> DataFrame:
    """Rows of the round to come."""
    last = stats.agg(F.max("pos").alias("pos"))
    return stats.join(F.broadcast(last), "pos", "left_semi")  # one row


FEATURES = (
    "base_score hot_boost cold_boost neighbor_boost carryover_boost reverse_boost hmm_hot_prob hmm_cold_prob poisson_penalty markov_penalty frequency_recent_10 frequency_recent_20 "
    "frequency_all gap_since_last number_value streak_length pair_freq_recent zone_low zone_mid zone_high lag_1_appeared lag_2_appeared odd_even frequency_variance "
    "rank_percentile recency_score gap_variance cycle_phase"
).split()


def carried(draws: DataFrame) -> DataFrame:
    """``block``, ``in``: for each of the 45 numbers what the blocks before say of it.

    Appearances and their positions' sum, the last round and the last position
    it was absent from, number, sum and sum of squares of gaps, and the longest
    run.  One row a block and number goes through windows over blocks.
    """
    rows = blocks.dealt(blocks.numbered(draws), 2).filter("own")
    first, size = F.shiftleft(F.col("block"), blocks.BLOCK_BITS), 1 << blocks.BLOCK_BITS  # the position before the block's first
    shown = rows.filter("c IS NOT NULL").select("block", "pos", "round", F.explode("c").alias("number"))
    w = Window.partitionBy("block", "number").orderBy("pos")
    shown = shown.withColumns({"gap": F.col("round") - F.lag("round").over(w), "island": F.col("pos") - F.row_number().over(w)})
    run = F.count("*").over(Window.partitionBy("block", "number", "island"))
    shown = shown.withColumn("run", run)
    each = shown.groupBy("block", "number").agg(
        F.count("*").alias("n"), F.sum("pos").alias("weight"), F.min("round").alias("first"), F.max("round").alias("last"), F.count("gap").alias("gaps"),
        F.coalesce(F.sum("gap"), F.lit(0)).alias("gap1"), F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).alias("gap2"), F.max("run").alias("best"),
        F.max(F.when(F.col("island") == first, F.col("run"))).alias("prefix"), F.max(F.when(F.col("pos") == first + size, F.col("run"))).alias("suffix"),
    )
    every = rows.select("block").distinct().select("block", F.explode(F.sequence(F.lit(1), F.lit(45))).alias("number"))
    each = every.join(each, ["block", "number"], "left").withColumn("absent", first + size - F.coalesce("suffix", F.lit(0)))
    each = each.withColumn("absent", F.when(F.coalesce("suffix", F.lit(0)) < size, F.col("absent")))  # a block without an absence says nothing of it
    earlier = Window.partitionBy("number").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    each = each.withColumns({"n_in": sums("n"), "weight_in": sums("weight"), "last_in": F.max("last").over(earlier), "absent_in": F.coalesce(F.max("absent").over(earlier), F.lit(0))})
    across = F.col("first") - F.col("last_in")  # the gap over the block's border
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = each.withColumns({
        "gaps": z("gaps") + across.isNotNull().cast("int"), "gap1": z("gap1") + F.coalesce(across, F.lit(0)), "gap2": z("gap2") + F.coalesce(across * across, F.lit(0)),
        "best": F.greatest(z("best"), F.when(F.col("prefix").isNotNull(), F.col("prefix") + first - F.col("absent_in")).otherwise(0)),
    })
    names = ("n_in", "weight_in", "last_in", "absent_in")
    each = each.select("block", "number", *names, *[sums(c).alias(f"{c}_in") for c in ("gaps", "gap1", "gap2")], F.coalesce(F.max("best").over(earlier), F.lit(0)).alias("best_in"))
    return each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*[c for c in each.columns if c != "block"]))).alias("in"))


def features(draws: DataFrame, min_rows: int = 50, poisson: float = 0.5, markov_weight: float = 0.3, hidden: bool = True) -> DataFrame:
    """The feature matrix of all rounds with at least ``min_rows`` before them (the one to come too, its ``label`` 0).

    ``pos``, ``round``, ``number``, the columns of ``FEATURES``, ``label``.  All
    is computed inside blocks of rounds; only rows of rounds are shuffled.
    Without ``hidden`` no state is fitted, and its two columns are 0.
    """
    extra = followers(draws).join(paired(draws), "pos", "full_outer")
    if hidden:
        extra = extra.join(hmm.states_as_of(draws, min_rows), "pos", "full_outer")
    names = [c for c in extra.columns if c != "pos"]
    g = grid(draws, RECENT, extra, carried(draws))
    w = in_block()
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own, drawn = F.col("own"), F.col("own") & (F.col("a") == 1)
    of = lambda c: F.coalesce(F.col(f"in.{c}_in"), F.lit(0))
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    frequency = lambda k: F.when(n_rows(k) > 0, seen(k) / (6.0 * n_rows(k))).otherwise(0.0)
    shown = F.greatest(F.col("in.last_in"), F.max(F.when(drawn, F.col("round"))).over(before))
    absent = F.greatest(of("absent"), F.max(F.when(own & (F.col("a") == 0), F.col("pos"))).over(upto))
    at = (*names, "block", "last_shown", "previous", "f10", "f20", "f50", "earlier")
    g = g.withColumns({"last_shown": shown, "run": F.when(drawn, F.col("pos") - absent), "previous": F.lag("round", 1).over(w), "f10": frequency(10), "f20": frequency(20), "f50": frequency(50)})
    g = g.withColumn("gap", F.when(drawn, F.col("round") - F.col("last_shown")))
    past = {
        "shown": of("n") + sums(drawn.cast("int")), "weight": of("weight") + sums(F.when(drawn, F.col("pos"))), "streak": F.greatest(of("best"), F.coalesce(F.max("run").over(before), F.lit(0))),
        "gaps": of("gaps") + F.count("gap").over(before), "gap1": of("gap1") + sums("gap"), "gap2": of("gap2") + sums(F.col("gap") * F.col("gap")),
    }
    g = flags(g.withColumns(past), RECENT, (*at, *past)).filter(F.col("pos") > min_rows)
    known = F.col("pos") - 1
    fs = F.filter(F.array(*[F.when(known >= k, F.col(f"f{k}")) for k in (10, 20, 50)]), lambda x: x.isNotNull())
    mean = F.aggregate(fs, F.lit(0.0), lambda s, x: s + x) / F.size(fs)
    spread = F.when(known >= 10, F.aggregate(fs, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(fs)).otherwise(0.0)
    n_gaps = F.col("gaps").cast("double")
    of_round = Window.partitionBy("block", "pos")
    top = F.max("weight").over(of_round)
    n, d = F.col("number"), "double"
    number = lambda c: F.coalesce(F.col(c).cast(d), F.lit(0.0))
    state = lambda k: (F.coalesce("states", F.lit(0)) == k).cast(d) if hidden else F.lit(0.0)
    return g.select(
        "pos", "round", "number", F.col("base").alias("base_score"), F.col("hot").cast(d).alias("hot_boost"), F.col("cold").cast(d).alias("cold_boost"),
        F.col("neighbor").cast(d).alias("neighbor_boost"), F.greatest("carryover", "carryover2").cast(d).alias("carryover_boost"), F.col("reverse").cast(d).alias("reverse_boost"),
        state(hmm.HOT).alias("hmm_hot_prob"), state(hmm.COLD).alias("hmm_cold_prob"),
        (F.col("excess") * poisson).alias("poisson_penalty"), (number("m") * markov_weight).alias("markov_penalty"),
        F.col("f10").alias("frequency_recent_10"), F.col("f20").alias("frequency_recent_20"), F.when(known > 0, F.col("shown") / (6.0 * known)).otherwise(0.0).alias("frequency_all"),
        ((F.col("previous") - F.coalesce("last_shown", F.lit(0))) / F.col("previous")).alias("gap_since_last"), (n / 45.0).alias("number_value"),
        (F.col("streak") / 10.0).alias("streak_length"), number("pair").alias("pair_freq_recent"), n.between(1, 15).cast(d).alias("zone_low"), n.between(16, 30).cast(d).alias("zone_mid"), n.between(31, 45).cast(d).alias("zone_high"),
        F.col("carryover").cast(d).alias("lag_1_appeared"), F.col("earlier").cast(d).alias("lag_2_appeared"), (n % 2).cast(d).alias("odd_even"), spread.alias("frequency_variance"),
        ((F.rank().over(of_round.orderBy("base")) - 1) / 45.0).alias("rank_percentile"), F.when(top > 0, F.col("weight") / top).otherwise(0.0).alias("recency_score"),
        F.when(n_gaps > 1, (n_gaps * F.col("gap2") - F.col("gap1") * F.col("gap1")) / (n_gaps * n_gaps)).otherwise(0.0).alias("gap_variance"), ((n % 7) / 7.0).alias("cycle_phase"), F.col("a").cast(d).alias("label"),
    )


def paired(draws: DataFrame) -> DataFrame:
    """``pos``, ``pair``: for each number the share of draws before the last one that hold it and share a number with the last draw.

    Counts of all sets of numbers go from round to round inside blocks of
    rounds; a block begins with what those before it counted.
    """
    return tallies.paired(blocks.numbered(draws))


def pair_frequency(draws: DataFrame) -> DataFrame:
    """``pos``, ``number``, ``pair_freq_recent``: the rows of ``paired``."""
    return paired(draws).select("pos", F.posexplode("pair").alias("at", "pair_freq_recent")).select("pos", (F.col("at") + 1).alias("number"), "pair_freq_recent")
