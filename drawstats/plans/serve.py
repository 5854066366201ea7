"""Presets, recommendations, and the serving document."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import combos
from ..operators import blocks, history, hmm, ranking, sampling, scores

HISTORY_OVERLAP = 5


@dataclass(frozen=True)
class Preset:
    name: str
    limits: combos.Limits
    samples: int
    top_k: int
    max_overlap: int
    temperature: float
    floor: float
    rare: bool
    excluded: tuple[int, ...]
    carry_limit: int
    bias: int
    seed_step: int


#: The two presets.
PRESETS = {
    "A": Preset("A", combos.Limits(), 100_000, 180, 3, 0.5, 0.005, True, (8,), 2, -5, 11),
    "B": Preset("B", combos.Limits(90, 185, 5, 4, 3, (1, 5), (1, 5)), 100_000, 220, 4, 0.65, 0.003, False, (), 3, 8, 29),
}
GAMES = (5, 10)


def seed_of(base: int, preset: Preset) -> int:
    return base * 131 + preset.seed_step


def near(stats: DataFrame) -> list[int]:
    """Numbers of the last two draws, from the table of the round to come (45 rows)."""
    return [r.number for r in stats.filter("carryover = 1 OR carryover2 = 1").select("number").collect()]


def passes(preset: Preset, carried: list[int]) -> Column:
    ok = F.lit(True)
    c = F.col("c")
    near_by = F.array(*[F.lit(x) for x in carried]).cast("array<int>")
    for _, test in combos.filters(c, preset.limits) + combos.special_filters(c, preset.excluded, near_by, preset.carry_limit, preset.rare):
        ok = ok & test
    return ok


def reasons(preset: Preset) -> Column:
    """What the preset's filters promise, as an array of strings."""
    x = preset.limits
    out = [f"AC>={x.min_ac}", f"sum {x.sum_low}-{x.sum_high}", f"zone<={x.zone_max}", f"odd {x.odd[0]}-{x.odd[1]}", f"high {x.high[0]}-{x.high[1]}", f"history overlap < {HISTORY_OVERLAP}"]
    return F.array(*[F.lit(r) for r in [*out, f"carryover<={preset.carry_limit}"]])


def serving_scores(draws: DataFrame, hidden: bool = True) -> DataFrame:
    """The 45 numbers of the round to come with ``score`` (no penalties) and ``t``, their tags; hidden states add to both."""
    rows = scores.latest(draws).withColumn("score", scores.score(scores.SERVING)).withColumn("t", scores.tags())
    if not hidden:
        return rows
    more = hmm.boosts(hmm.states_of(rows)).select("number", "value", "tag")
    rows = rows.join(more, "number")
    return rows.withColumn("score", F.col("score") + F.col("value")).withColumn("t", F.when(F.col("tag").isNotNull(), F.array_append("t", F.col("tag"))).otherwise(F.col("t"))).drop("value", "tag")


def kept(drawn: DataFrame, preset: Preset, carried: list[int], draws: DataFrame, relaxed: bool = True) -> DataFrame:
    """Samples that pass the filters and share fewer than five numbers with every draw; if none does, all samples (``relaxed``) or none."""
    good = blocks.kept(history.unseen(drawn.filter(passes(preset, carried)), draws, HISTORY_OVERLAP))  # looked at, then ranked
    return drawn if relaxed and good.isEmpty() else good


def rejected_by(drawn: DataFrame, preset: Preset, carried: list[int], draws: DataFrame) -> DataFrame:
    """``drawn`` with ``failed_filter``: the first predicate of the worker's order that fails, ``history`` if only a draw
    with five numbers in common is against it, ``passed`` if nothing is.  A repeated combination has one answer."""
    near_by = F.array(*[F.lit(x) for x in carried]).cast("array<int>")
    failed = combos.first_failure(combos.worker_filters(F.col("c"), preset.limits, preset.excluded, near_by, preset.carry_limit, preset.rare))
    rows = drawn.withColumn("_failed", failed)
    new = history.unseen(rows.filter("_failed IS NULL").select("c").distinct(), draws, HISTORY_OVERLAP).withColumn("_new", F.lit("passed"))
    return rows.join(new, "c", "left").withColumn("failed_filter", F.coalesce("_failed", "_new", F.lit("history"))).drop("_failed", "_new")


def recommend(draws: DataFrame, preset: str = "A", games: int = 5, seed: int = 42, n_samples: int | None = None, hidden: bool = True, relaxed: bool = True) -> DataFrame:
    """``place``, ``c``, ``combo_score``, ``percentile``, ``tags``, ``reasons``: combinations for the round to come.

    Where no sample passes the filters, all are ranked, or without ``relaxed`` none, and there is no row.
    """
    if preset not in PRESETS or games not in GAMES:
        raise ValueError("preset A or B, 5 or 10 games")
    p, spark = PRESETS[preset], draws.sparkSession
    rows = serving_scores(draws, hidden).select("number", "score", "carryover", "carryover2", "t").collect()  # 45 rows
    stats = spark.createDataFrame(rows, "number int, score double, carryover int, carryover2 int, t array<string>").coalesce(1)
    table = scores.probabilities(stats.select("number", "score"), p.temperature, p.floor, [])
    drawn = sampling.samples(table, n_samples or p.samples, seed_of(seed, p))
    ranks = ranking.ranked(ranking.scored(kept(drawn, p, near(stats), draws, relaxed), stats).withColumn("combo_score", F.round("combo_score", 9)), p.top_k)
    best = ranks.collect()  # at most top_k rows
    ranks = spark.createDataFrame(best, ranks.schema).coalesce(1)
    chosen = ranking.filled(ranking.diverse(ranks, games, p.max_overlap), ranks, games)
    tags = stats.select("number", "t")
    with_tags = chosen.select("c", F.explode("c").alias("number")).join(F.broadcast(tags), "number").groupBy("c").agg(combos.preferred_tags(F.flatten(F.collect_list("t"))).alias("tags"))
    level = ranking.percentile(chosen, ranks, p.bias)
    value = ranks.groupBy("c").agg(F.first("combo_score").alias("combo_score"))
    return chosen.join(value, "c").join(with_tags, "c").crossJoin(F.broadcast(level)).select("place", "c", F.bround("combo_score", 6).alias("combo_score"), "percentile", "tags", reasons(p).alias("reasons"))


def pool(recommendations: DataFrame, cursor: int) -> DataFrame:
    """The variant that a rotating cursor points at, of a table of recommendations with ``variant_id`` 0 .. n - 1."""
    n = recommendations.agg((F.max("variant_id") + 1).alias("n"))
    return recommendations.crossJoin(F.broadcast(n)).filter(F.col("variant_id") == F.lit(cursor) % F.col("n")).drop("n")


def attempts(rate: Column, top_k: int) -> Column:
    """Tries that a sampling loop is given, from the share of accepted samples."""
    return F.least(F.lit(60000.0), F.greatest(F.lit(8000.0), F.bround(F.lit(float(max(3 * top_k, 800))) / F.greatest(rate, F.lit(0.02))))).cast("long")


def quantiles(combinations: DataFrame) -> DataFrame:
    """``p10`` .. ``p90`` of ``combo_score``; zeros without rows."""
    at = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = combinations.agg(F.percentile("combo_score", F.array(*[F.lit(x) for x in at])).alias("q"))
    return q.select(*[F.coalesce(F.col("q")[i], F.lit(0.0)).alias(f"p{int(x * 100)}") for i, x in enumerate(at)])


def document(draws: DataFrame, preset: str = "A", seed: int = 42, n_samples: int | None = None, trees: dict | None = None) -> DataFrame:
    """One row, ``document``: the JSON that a page needs to make recommendations by itself.

    ``trees`` is what a tree model says of the round to come (``ml.for_document``).
    """
    p, spark = PRESETS[preset], draws.sparkSession
    n = n_samples or p.samples
    rows = serving_scores(draws).select("number", "score", "carryover", "carryover2", "t").collect()  # 45 rows
    stats = spark.createDataFrame(rows, "number int, score double, carryover int, carryover2 int, t array<string>").coalesce(1)
    base = scores.probabilities(stats.select("number", "score"), p.temperature, p.floor, [])
    carried = near(stats)
    good = sampling.samples(base, n, seed_of(seed, p)).filter(passes(p, carried))
    blend = sampling.blended(base, sampling.number_shares(good))
    row = lambda df, c: F.transform(F.array_sort(F.collect_list(F.struct("number", c))), lambda x: x[c])
    parts = stats.agg(row(stats, "score").alias("raw_scores"), row(stats, "t").alias("tags")).crossJoin(blend.agg(row(blend, "p").alias("sampling_weights")))
    parts = parts.crossJoin(draws.agg(F.array_sort(F.collect_set(combos.key(F.col("c")))).alias("exact_keys"), F.max("round").alias("latest_round")))
    subsets = draws.filter("c IS NOT NULL").select(F.explode(F.transform(combos.five_subsets(F.col("c")), combos.key)).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("five_subset_keys"))
    parts = parts.crossJoin(subsets).crossJoin(quantiles(ranking.scored(good, stats))).crossJoin(good.agg((F.count("*") / n).alias("rate")))
    content = F.struct(
        F.lit(1).alias("schema_version"), F.lit(preset).alias("preset"), "latest_round", "raw_scores", "tags", "sampling_weights",
        F.struct("exact_keys", "five_subset_keys").alias("history"), F.array(*[F.lit(x) for x in carried]).cast("array<int>").alias("carryover_numbers"),
        F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in combos.RARE_PAIRS]).alias("rare_pairs"), reasons(p).alias("reasons"),
        F.struct("p10", "p25", "p50", "p75", "p90").alias("quantiles"), attempts(F.col("rate"), p.top_k).alias("max_attempts"),
        *([F.from_json(F.lit(json.dumps(trees)), "model string, params map<string,double>, scores array<double>, importances map<string,double>").alias("trees")] if trees else []),
    )
    return parts.select(F.to_json(content).alias("document"))


def write_documents(documents: dict[str, DataFrame], folder: str) -> None:
    """Each document as one JSON file below ``folder``."""
    for name, df in documents.items():
        df.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def status(recommendations: DataFrame) -> DataFrame:
    """``preset``, ``games``, ``variants`` of a table of recommendations made beforehand."""
    return recommendations.groupBy("preset", "games").agg(F.countDistinct("variant_id").alias("variants"))
