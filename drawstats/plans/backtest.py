"""Walk-forward backtests, hit metrics, fitness of weight vectors, grid search."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import combos
from ..operators import blocks, ranking, sampling, scores

#: Scores that are equal to so many digits tie, whatever the order of their sums.
DIGITS = 12
LEAST_TRAIN, LEAST_VALIDATION = 50, 10


def summary(rounds: DataFrame, hits: str = "hits", by: list[str] | None = None) -> DataFrame:
    """``p3``, ``p4``, ``mean_hits``, ``std_hits`` (population), ``n``; zeros where there is nothing."""
    h = F.col(hits)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return rounds.groupBy(*(by or [])).agg(
        z(F.avg((h >= 3).cast("double"))).alias("p3"), z(F.avg((h >= 4).cast("double"))).alias("p4"), z(F.avg(h.cast("double"))).alias("mean_hits"),
        z(F.stddev_pop(h.cast("double"))).alias("std_hits"), F.count(h).alias("n"),
    )


def histogram(rounds: DataFrame, hits: str = "hits") -> DataFrame:
    return rounds.groupBy(hits).agg(F.count("*").alias("n"))


def compared(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of two summaries."""
    a, b = model.alias("a"), baseline.alias("b")
    return a.crossJoin(b).select(*[(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"{c}_diff") for c in ("p3", "p4", "mean_hits")])


#: The weights and sizes of the penalty tuner.
TUNER = scores.WEIGHTS | {"carryover": 0.2}
TUNER_SAMPLES, TUNER_TOP, TUNER_RECENT = 3000, 300, 50


def _noise(seed: Column, sample: Column) -> Column:
    """What 45 numbers have added to their log-weights in one sample."""
    return F.array(*[sampling.gumbel_top6(F.lit(1.0), F.lit(n), seed, sample) for n in range(1, 46)])


def _best_six(weights: Column) -> Column:
    """The numbers of the six largest of 45 values, sorted."""
    keyed = F.transform(weights, lambda v, i: F.struct((-v).alias("k"), (i + 1).alias("number")))
    return F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, combos.PICK), lambda x: x.number))


def seen_before(candidates: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """Candidates (``by``, ``pos``, ``c``) that share five numbers or more with a draw before ``pos``: ``by`` and ``pos``."""
    subsets = lambda c: F.explode(F.transform(c, lambda x: combos.mask(c) - F.call_function("shiftleft", F.lit(1).cast("long"), (x - 1).cast("int"))))
    past = scores.positions(draws).filter("c IS NOT NULL").select("pos", subsets(F.col("c")).alias("u")).groupBy("u").agg(F.min("pos").alias("first"))
    return candidates.select(*by, "pos", subsets(F.col("c")).alias("u")).join(past, "u").filter("first < pos").select(*by, "pos").distinct()


def walk_forward(draws: DataFrame, games: int = 5, n_samples: int = TUNER_SAMPLES, seed: int = 42, weights: list[dict[str, float]] | None = None, temperature: float = 1.0, floor: float = 0.001,
                 recent: int = scores.RECENT, tail: int | None = None, top_k: int = TUNER_TOP, max_overlap: int = 3, limits: combos.Limits = combos.Limits(),
                 start_round: int | None = None, end_round: int | None = None, train_tail: int | None = None) -> DataFrame:
    """``individual``, ``pos``, ``round``, ``game``, ``c``, ``hits``: for every round but the first (from ``start_round`` to
    ``end_round``), combinations chosen from what was known before it, for each of the ``weights``.

    All rounds' scores come from one as-of table, with transitions of the last
    ``tail`` draws.  Samples are keyed by the seed and the round's place; their
    noise is made once for all weights.  Filters, that against earlier draws
    among them, fall back to all samples where none passes.  What the diverse
    choice lacks is filled from the ranked, the sampled and equally likely
    combinations in turn.  ``train_tail`` cuts all that is known to so many draws.
    """
    for name, value in (("games", games), ("n_samples", n_samples), ("train_tail", 1 if train_tail is None else train_tail)):
        if value <= 0:
            raise ValueError(f"{name} must be positive")
    tail = tail if train_tail is None else min(train_tail, tail or train_tail)
    recent = recent if train_tail is None else min(recent, train_tail)
    vectors = list(enumerate(weights or [scores.WEIGHTS]))
    stats = scores.statistics(draws, recent, tail, start_round).filter("pos > 1")
    if end_round is not None:
        stats = stats.filter(F.col("round") <= end_round)
    every = F.array(*[F.struct(F.lit(i).alias("individual"), scores.score(w).alias("score")) for i, w in vectors])
    scored = stats.select("pos", "number", F.explode(every).alias("e")).select("pos", "number", "e.*")
    p = scores.probabilities(scored, temperature, floor, ["individual", "pos"])
    row = F.array_sort(F.collect_list(F.struct("number", "p", "score")))
    one = p.groupBy("pos", "individual").agg(row.alias("ps")).select("pos", "individual", F.transform("ps", lambda x: F.log(x.p)).alias("l"), F.transform("ps", lambda x: x.score).alias("s"))
    table = one.groupBy("pos").agg(F.collect_list(F.struct("individual", "l", "s")).alias("of"))
    drawn = scores.positions(draws).filter("c IS NOT NULL").select("pos", "round", F.col("c").alias("actual"))
    table = blocks.spread(table.join(drawn, "pos"), "pos")  # few rows before their samples are made
    each = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long"))).alias("sample_id"))
    each = each.select("*", sampling.once(_noise(F.lit(seed) + F.col("pos"), F.col("sample_id"))).alias("g")).select("pos", "round", "actual", "sample_id", "g", F.explode("of").alias("o"))
    each = each.select("pos", "round", "actual", "sample_id", "o.individual", F.col("o.s").alias("s"), sampling.once(_best_six(F.zip_with("o.l", "g", lambda x, y: x + y))).alias("c"))
    total = F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + F.element_at("s", x)), 9)
    passes = F.lit(True)
    for _, ok in combos.filters(F.col("c"), limits):
        passes = passes & ok
    each = each.select("individual", "pos", "round", "actual", "sample_id", "c", total.alias("combo_score"), passes.alias("ok"))
    by = ["individual", "sample_id"]
    told = seen_before(each.filter("ok").select(*by, "pos", "c"), draws, by).withColumn("seen", F.lit(True))
    each = each.join(told, [*by, "pos"], "left").withColumn("ok", F.col("ok") & F.col("seen").isNull())
    rows = each.groupBy("individual", "pos", "round", "actual").agg(
        F.max("ok").alias("any"), F.array_sort(F.collect_list(F.struct((-F.col("combo_score")).alias("k"), "sample_id", "c", "ok"))).alias("r")
    )  # n_samples rows a round
    order = F.transform(F.slice(F.filter("r", lambda x: x.ok | ~F.col("any")), 1, top_k), lambda x: x.c)
    sampled = F.transform(F.array_sort(F.transform("r", lambda x: F.struct(x.sample_id.alias("sample_id"), x.c.alias("c")))), lambda x: x.c)
    equal = F.transform(F.sequence(F.lit(0), F.lit(3 * games - 1)), lambda k: _best_six(_noise(F.concat(F.lit("equal|"), (F.lit(seed) + F.col("pos")).cast("string")), k)))
    rows = rows.select("individual", "pos", "round", "actual", order.alias("order"), sampled.alias("sampled")).withColumn("chosen", ranking.fold_diverse(F.col("order"), games, max_overlap))
    more = F.array_distinct(F.concat("chosen", "order", "sampled"))
    filled = F.when(F.size("chosen") >= games, F.col("chosen")).when(F.size(more) >= games, F.slice(more, 1, games)).otherwise(F.slice(F.array_distinct(F.concat(more, equal)), 1, games))
    out = rows.select("individual", "pos", "round", "actual", F.posexplode(filled).alias("game", "c"))
    return out.select("individual", "pos", "round", "game", "c", combos.overlap(F.col("c"), F.col("actual")).alias("hits"))


def fitness(stats: DataFrame, weights: DataFrame, train_end: int, val_end: int, train_rounds: int = 20, least_rows: int = 20, check: bool = True, rounds: DataFrame | None = None) -> DataFrame:
    """Per row of ``weights`` (``individual`` and a column per weight): hit rates, mean rank and the combined value.

    ``stats`` is the as-of table with ``label``; scores are linear in the
    weights, so all vectors are evaluated by one join with it.  ``weights`` is a
    small table (a population), broadcast.  ``rounds`` (``pos``, ``round``) are
    the drawn rounds, if ``stats`` is not to be read for them.
    """
    rounds = stats.filter("label IS NOT NULL").select("pos", "round").distinct() if rounds is None else rounds
    if check:
        n = rounds.agg(F.count(F.when(F.col("round") <= train_end, 1)).alias("t"), F.count(F.when((F.col("round") > train_end) & (F.col("round") <= val_end), 1)).alias("v")).first()
        if n.t < LEAST_TRAIN or n.v < LEAST_VALIDATION:
            raise ValueError(f"{LEAST_TRAIN} rounds to train and {LEAST_VALIDATION} to validate are needed, not {n.t} and {n.v}")
    last = last_rounds(rounds, train_end, train_rounds).select("pos").withColumn("train", F.lit(True))
    rows = stats.filter((F.col("pos") > least_rows) & (F.col("round") <= val_end)).join(F.broadcast(last), "pos", "left").withColumn("train", F.coalesce("train", F.lit(False)))
    rows = rows.filter(F.col("train") | (F.col("round") > train_end))
    s = F.greatest(
        F.lit(0.0),
        F.col("base") + F.col("hot") * F.col("w_hot") + F.col("cold") * F.col("w_cold") + F.col("neighbor") * F.col("w_neighbor") + (F.col("carryover") + F.col("carryover2")) * F.col("w_carryover")
        + F.col("reverse") * F.col("w_reverse") - F.col("excess") * F.col("w_poisson") - F.col("markov") * F.col("w_markov"),
    )
    by = ["block", "individual", "pos"] if "block" in stats.columns else ["individual", "pos"]  # rows lie by block already
    scored = rows.crossJoin(F.broadcast(weights)).select(*by, "number", "label", "train", F.round(s, DIGITS).alias("score"))
    per_round = ranking.hit_metrics(ranking.with_number_rank(scored, by), [*by, "train"])
    t, v = F.col("train"), ~F.col("train")
    out = per_round.groupBy("individual").agg(
        F.avg(F.when(t, F.col("hit_15"))).alias("train_hit_15"), F.avg(F.when(v, F.col("hit_15"))).alias("hit_15"),
        F.avg(F.when(v, F.col("hit_20"))).alias("hit_20"), F.avg(F.when(v, F.col("mean_rank"))).alias("mean_rank"),
    )
    return out.withColumn("combined", 0.4 * F.col("train_hit_15") + 0.5 * F.col("hit_15") + 0.1 * (45 - F.col("mean_rank")) / 45)


def last_rounds(rounds: DataFrame, train_end: int, train_rounds: int) -> DataFrame:
    """The last ``train_rounds`` of ``rounds`` (``pos``, ``round``) up to ``train_end``."""
    return rounds.filter(F.col("round") <= train_end).orderBy(F.desc("pos")).limit(train_rounds)


def fitness_of(draws: DataFrame, weights: DataFrame, train_end: int, val_end: int, train_rounds: int = 20, least_rows: int = 20) -> DataFrame:
    """``fitness`` over draws that several jobs read: statistics are made of the rounds that are scored alone, with all rounds before them counted."""
    known = blocks.numbered(draws).crossJoin(F.broadcast(draws.agg(F.max("round").alias("e")))).filter(F.col("round") <= F.col("e")).select("pos", "round")
    start = last_rounds(known, train_end, train_rounds).agg(F.min("round").alias("r")).first().r
    return fitness(labelled(draws, start_round=start), weights, train_end, val_end, train_rounds, least_rows, rounds=known)


def labelled(draws: DataFrame, recent: int = scores.RECENT, start_round: int | None = None) -> DataFrame:
    """Statistics with ``label`` (null for the round to come), from ``start_round`` on, if given."""
    end = draws.agg(F.max("round").alias("e"))
    return scores.statistics(draws, recent, start_round=start_round).crossJoin(F.broadcast(end)).withColumn("label", F.when(F.col("round") <= F.col("e"), F.col("a"))).drop("e")


def penalty_grid(start: float, end: float, step: float) -> list[float]:
    if step <= 0 or end < start:
        raise ValueError("a positive step and end >= start are needed")
    n = int((end - start) / step + 0.5)
    return [round(start + i * step, 6) for i in range(n + 1)]


def grid_search(draws: DataFrame, poisson: list[float], markov: list[float], base_weights: dict[str, float] | None = None, **options) -> DataFrame:  # noqa: ANN003
    """For every pair of penalties the summary of a walk-forward run with the tuner's settings, best pair first:
    ``lambda_poisson``, ``lambda_markov``, ``p3``, ``p4``, ``mean_hits``, ``std_hits``, ``n``.  One job over all pairs and rounds.
    """
    for x in (*poisson, *markov):
        if not 0 <= x <= scores.MAX_PENALTY:
            raise ValueError(f"penalty {x} outside 0..{scores.MAX_PENALTY}")
    if not poisson or not markov:
        raise ValueError("a grid must not be empty")
    pairs = [(float(a), float(b)) for a in poisson for b in markov]
    options = {"n_samples": TUNER_SAMPLES, "top_k": TUNER_TOP, "tail": TUNER_RECENT} | options
    played = walk_forward(draws, weights=[(base_weights or TUNER) | {"poisson": a, "markov": b} for a, b in pairs], **options)
    at = F.array(*[F.struct(F.lit(a).alias("p"), F.lit(b).alias("m")) for a, b in pairs])
    pair = F.get(at, F.col("individual"))
    out = summary(played, by=["individual"]).select(pair.p.alias("lambda_poisson"), pair.m.alias("lambda_markov"), "p3", "p4", "mean_hits", "std_hits", "n")
    return out.orderBy(F.desc("p3"), F.desc("p4"), F.desc("mean_hits"), "std_hits")


def save_grid(results: DataFrame, settings: dict, path: str) -> None:
    """Settings and results as one JSON file."""
    content = F.struct(F.lit(json.dumps(settings, sort_keys=True)).alias("config"), F.collect_list(F.struct(*results.columns)).alias("results"))
    results.agg(F.to_json(content).alias("document")).coalesce(1).write.mode("overwrite").text(path)


def single_round(draws: DataFrame, upto: int, games: int = 5, **options) -> DataFrame:  # noqa: ANN003
    """``game``, ``c``, ``hits``, ``bonus_hit``, ``prize``: combinations for the round after ``upto`` against its draw; best first."""
    last = draws.agg(F.max("round").alias("m")).first().m or 0
    if not 100 <= upto < last:
        raise ValueError(f"a round from 100 to {last - 1} is needed")
    after = draws.filter(F.col("round") > upto).agg(F.min("round").alias("m")).first().m
    known = draws.filter(F.col("round") <= after)
    played = walk_forward(known, games, start_round=after, end_round=after, **options)
    return prizes(played.select("pos", "game", "c"), known).orderBy(F.desc("hits"), "game")


def prizes(played: DataFrame, draws: DataFrame) -> DataFrame:
    """``played`` (``pos``, ``c``) with ``hits``, ``bonus_hit`` and ``prize`` against the draw at ``pos``."""
    drawn = scores.positions(draws).filter("c IS NOT NULL").select("pos", F.col("c").alias("actual"), "bonus")
    hits = combos.overlap(F.col("c"), F.col("actual"))
    bonus: Column = F.coalesce(F.array_contains("c", F.col("bonus")), F.lit(False))
    return played.join(drawn, "pos").select(*[f"`{c}`" for c in played.columns], hits.alias("hits"), bonus.alias("bonus_hit"), combos.prize(hits, bonus).alias("prize"))


def report(one_summary: dict, hist: dict[int, int]) -> tuple[dict, str]:
    """A JSON document and a Markdown table of a summary."""
    document = {"metrics": one_summary, "histogram": {str(k): v for k, v in sorted(hist.items())}}
    lines = ["| metric | value |", "|---|---|", *[f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in one_summary.items()]]
    return document, "\n".join(lines)
