"""Adaptive rejection, ranks and choices over blocks, and the first draw that shares too much, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from drawstats.functions import combos
from drawstats.operators import history, ranking, sampling


@pytest.fixture(scope="module")
def odds(spark):
    r = random.Random(3)
    w = [r.random() + 0.1 for _ in range(45)]
    return spark.createDataFrame([(n + 1, x / sum(w)) for n, x in enumerate(w)], "number int, p double").coalesce(1).cache()


def plain_run(rows, passes, relaxed, games, most, target):
    """As a loop over samples one by one: accepted combinations, and the samples looked at."""
    got, attempts = {}, 0
    while attempts < most and len(got) < target:
        c = rows[attempts]
        if c not in got and passes(c):
            got[c] = (attempts, 0)
        attempts += 1
    if len(got) < games:
        n, limit = 0, max(6000, int(most * 0.35))
        while len(got) < games * 8 and n < limit:
            c = rows[most + n]
            if c not in got and relaxed(c):
                got[c] = (most + n, 1)
            n += 1
        attempts += n
    return got, attempts


@pytest.mark.parametrize(("least", "games", "most"), [(100, 5, 3000), (195, 5, 9000), (215, 20, 500), (400, 5, 300)])
def test_adaptive_rejection(spark, odds, monkeypatch, least, games, most):
    monkeypatch.setattr(sampling, "FIRST_BATCH", 400)
    rows = [tuple(r.c) for r in sampling.samples(odds, most + 6000, 9).orderBy("sample_id").collect()]
    run = sampling.adaptive(odds, lambda df: df.filter(combos.total(F.col("c")) >= least), lambda df: df.filter(~F.array_contains("c", 7)), games, most, 9)
    want, attempts = plain_run(rows, lambda c: sum(c) >= least, lambda c: 7 not in c, games, most, max(350, 70 * games))
    assert {tuple(r.c): (r.sample_id, r.phase) for r in run.rows.collect()} == want and run.attempts == attempts
    assert sum(run.batches) >= attempts and (least > 100 or sum(run.batches) < most)  # no more is drawn than the rate asks for
    with pytest.raises(ValueError):
        sampling.adaptive(odds, lambda df: df, lambda df: df, 0, 10)
    with pytest.raises(ValueError):
        sampling.samples(odds.drop("p"), 3)


def greedy(ordered, count, overlap):
    out = []
    for c in ordered:
        if len(out) < count and c not in out and all(len(set(c) & set(g)) <= overlap for g in out):
            out.append(c)
    return out


@pytest.mark.parametrize(("count", "overlap"), [(5, 3), (12, 2), (40, 1), (9, 6)])
def test_choice_over_blocks(spark, monkeypatch, count, overlap):
    r = random.Random(count)
    ordered = [sorted(r.sample(range(1, 20), 6)) for _ in range(900)]
    ranks = spark.createDataFrame([(i + 1, c) for i, c in enumerate(ordered)], "rank long, c array<int>").repartition(4).cache()
    for first in (7, 64, 4096):
        monkeypatch.setattr(ranking, "FIRST_BLOCK", first)
        assert ranking.diverse_in_blocks(ranks, count, overlap).first().chosen == greedy(ordered, count, overlap)
    assert ranking.choose(ranks.limit(0), 3, 3) == []
    with pytest.raises(ValueError):
        ranking.choose(ranks, 0, 3)


def test_ranks_over_cells(spark):
    r = random.Random(1)
    rows = [(i, r.choice([0.5, -1.25, 3.0, r.random() * 6 - 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "sample_id long, combo_score double").repartition(5)
    want = [i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))]
    assert [x.sample_id for x in ranking.ranked(df).orderBy("rank").collect()] == want
    assert sorted(x["rank"] for x in ranking.ranked(df).collect()) == list(range(1, 501))
    assert [x.sample_id for x in ranking.ranked(df, 20).orderBy("rank").collect()] == want[:20]


@pytest.mark.parametrize("threshold", [1, 2, 3, 4, 5, 6])
def test_first_match(spark, threshold):
    r = random.Random(threshold)
    draws = [sorted(r.sample(range(1, 46), 6)) for _ in range(60)]
    candidates = [sorted(r.sample(range(1, 46), 6)) for _ in range(60)] + draws[3:6] + [sorted({*draws[9][:5], 45 if 45 not in draws[9] else 44})]
    past = spark.createDataFrame([(i * 3, c, None) for i, c in enumerate(draws)], "round long, c array<int>, bonus int").repartition(3)
    df = spark.createDataFrame([(c,) for c in candidates if len(c) == 6], "c array<int>")
    got = {tuple(x.c): (x.first, x.overlap) for x in history.first_matches(df, past, threshold).collect()}
    said = {tuple(x.c): x for x in history.with_reasons(df, past, threshold).collect()}
    for c in got:
        want = next(((i + 1, len(set(c) & set(d))) for i, d in enumerate(draws) if len(set(c) & set(d)) >= threshold), (None, None))
        assert got[c] == want and said[c].passed == (want[0] is None)
        assert said[c].reason is None if want[0] is None else f"shares {want[1]} numbers" in said[c].reason
    with pytest.raises(ValueError):
        history.first_matches(df, past, 7)
    assert history.first_matches(df, past.limit(0), threshold).filter("first IS NOT NULL").count() == 0


