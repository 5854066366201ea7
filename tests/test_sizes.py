"""Queries over all rows, and the bounds of what their steps shuffle and hold."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawstats import catalog
from drawstats.operators import blocks, sampling, scores, tallies
from drawstats.plans import backtest, serve, tuning

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_history_filter_3_goes_back_to_the_first_draw(spark):
    past = [set(r.c) for r in catalog.draws_of(spark, DATA).collect()]
    got = [set(map(int, r.combo.split("-"))) for r in catalog.QUERIES["history_filter_3"](spark, DATA).collect()]
    assert len(past) > 40 and all(len(c & d) < 3 for c in got for d in past)
    assert "max(pos)" not in catalog.ORACLES["history_filter_3"].split("h AS (")[1]


@pytest.fixture(scope="module")
def rounds(spark):
    r = random.Random(8)
    rows = [(3 * i, sorted(r.sample(range(1, 46) if i % 3 else range(1, 10), 6 if i % 40 else 5)), None) for i in range(300)]
    return rows, spark.createDataFrame(rows, "round long, c array<int>, bonus int").repartition(3).cache()


def arrays_shuffled(df):
    """Columns that are arrays, which the windows after would sort with each number's row."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def test_pairs_over_blocks(spark, rounds):
    rows, df = rounds
    draws = [set(c) for _, c, _ in rows]
    got = {r.pos: r.pair for r in tallies.paired(blocks.numbered(df), bits=6).collect()}
    assert sorted(got) == list(range(2, len(rows) + 2))
    for t in (2, 3, 64, 65, 66, 130, 257, 301):
        prior, last = draws[: t - 2], draws[t - 2]
        assert got[t] == pytest.approx([sum(n in d and bool(d & last) for d in prior) / len(prior) if prior else 0 for n in range(1, 46)])


def test_pairs_shuffle_rounds_alone(rounds):
    plan = scores.paired(rounds[1])._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "Window [sum" not in plan  # no row for each subset of a draw


def test_the_grid_sorts_no_arrays(rounds):
    df = rounds[1]
    extra = scores.followers(df).join(scores.paired(df), "pos", "full_outer")
    assert arrays_shuffled(scores.grid(df, 50, extra, scores.carried(df))) == []


def test_statistics_from_a_round_on(rounds):
    df = rounds[1]
    for tail in (None, 20):
        every = scores.statistics(df, 50, tail).filter("round >= 800")
        some = scores.statistics(df, 50, tail, 800)
        assert sorted(map(str, some.collect())) == sorted(map(str, every.collect())) and some.count() == 34 * 45
    assert scores.statistics(df, start_round=10**6).count() == 0


def test_no_recommendation_where_every_sample_was_drawn(spark):
    n = 200
    seen = sampling.samples(sampling.uniform_table(spark.range(1)), 30, 5).select(F.col("sample_id").alias("round"), "c", F.lit(None).cast("int").alias("bonus"))
    stats = spark.createDataFrame([(k, 0.5) for k in range(1, 46)], "number int, score double")
    drawn = sampling.samples(scores.probabilities(stats, 0.5, 0.005, []), n, 5)
    past = drawn.select(F.col("sample_id").alias("round"), "c", F.lit(None).cast("int").alias("bonus"))
    p = serve.PRESETS["A"]
    assert serve.kept(drawn, p, [], past, relaxed=False).count() == 0 and serve.kept(drawn, p, [], past).count() == n
    assert serve.kept(drawn, p, [], seen.limit(1), relaxed=False).count() < n


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_rounds_before_cost_the_same_for_any_frame(rounds):
    rows, df = rounds
    assert not re.search(r"RowFrame, -(?!1,)\d+, -1\)", plan(scores.statistics(df)))  # no frame that goes through its rows again for each row
    got = {(r.pos, r.number): r for r in scores.statistics(df, 60).collect()}
    for t in (1, 2, 6, 21, 61, 257, 258, 301):
        for n in (1, 9, 45):
            past = [n in c for _, c, _ in rows[: t - 1]]
            r = got[t, n]
            assert (r.base, r.hot, r.cold) == (pytest.approx((1 + sum(past[-60:])) / (2 + len(past[-60:]))), sum(past[-5:]) >= 2, bool(past) and not any(past[-10:]))
            assert r.excess == pytest.approx(max(0, sum(past[-20:]) - len(past[-20:]) * 6 / 45))


def test_fitness_of_draws_equals_that_of_all_statistics(spark, rounds):
    df = rounds[1]
    w = tuning.weight_table(spark, catalog._WEIGHTS)
    want = backtest.fitness(backtest.labelled(df).drop("block"), w, 600, 850)  # joins and ranks by round
    got = backtest.fitness_of(df, w, 600, 850)
    shuffled = r"hashpartitioning\([^)]*individual#\d+, pos#"  # a row for each vector, round and number
    assert re.search(shuffled, plan(want)) and not re.search(shuffled, plan(got))
    assert [tuple(r) for r in got.orderBy("individual").collect()] == [pytest.approx(tuple(r)) for r in want.orderBy("individual").collect()]
    for ends in ((100, 890), (880, 890), (-5, 890)):
        with pytest.raises(ValueError):
            backtest.fitness_of(df, w, *ends)


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_weight_fitness_makes_statistics_of_the_scored_rounds_alone(spark, monkeypatch):
    made, plain = [], backtest.labelled
    monkeypatch.setattr(backtest, "labelled", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    assert catalog.QUERIES["weight_fitness"](spark, DATA).count() == len(catalog._WEIGHTS)
    n = catalog.draws_of(spark, DATA).count()
    assert n > 100 and [df.select("pos").distinct().count() for df in made] == [20 + n - int(n * 0.8) + 1]


def test_samples_of_equal_weights(spark, rounds):
    groups = spark.createDataFrame([(k, k % 3) for k in range(40)], "pos long, x int")
    equal = groups.select("pos", F.explode(F.sequence(F.lit(1), F.lit(45))).alias("number"), F.lit(1.0 / 45).alias("p"))
    want = sampling.samples(equal, 7, F.lit(3) + F.col("pos"), ["pos"], start=2).join(groups, "pos")
    got = sampling.equal_samples(groups, 7, F.lit(3) + F.col("pos"), start=2)
    key = ("pos", "x", "sample_id", "c")
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect())) and got.count() == 280


def test_of_equal_digits_the_smaller_number_is_taken(spark, monkeypatch):
    monkeypatch.setattr(sampling.combos, "digest", lambda keyed: F.when(keyed.rlike("[|](45|9|30)$"), "0000000a").otherwise("00000009"))
    got = sampling.equal_samples(spark.range(1), 1).first()
    assert got.c == [1, 2, 3, 9, 30, 45]


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_random_baseline_deals_rounds_out_and_shuffles_no_numbers(spark):
    df = catalog.QUERIES["random_baseline"](spark, DATA)
    text = plan(df)
    assert "REPARTITION_BY_NUM" in text and "ObjectHashAggregate" not in text.split("REPARTITION_BY_NUM")[0] and "Join" not in text.split("REPARTITION_BY_NUM")[0]
    assert text.count("parquet") == 0  # draws are made once, not in each branch
    assert df.count() == 5 * catalog.draws_of(spark, DATA).count()
