"""Boosted trees against a plain split search, the parameter search, and the ranker."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drawstats.operators import scores
from drawstats.plans import boosting, ml, search, serve
from drawstats.plans.boosting import Trees

COLUMNS = list("abcd")


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(1)
    n = 45 * 30
    x = np.round(r.normal(size=(n, 4)), 1)
    y = (r.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * (x[:, 1] > 0.5))))).astype(float)
    df = pd.DataFrame(x, columns=COLUMNS).assign(label=y, pos=np.arange(n) // 45 + 1, number=np.arange(n) % 45 + 1)
    return x, y, spark.createDataFrame(df).repartition(3).cache()


def plain(x, y, p, weight, allowed=None, used=None):
    """Trees by trying every value of every column at every node; their margins."""
    margin = np.zeros(len(y))
    pulled = lambda g: np.sign(g) * max(abs(g) - p.alpha, 0)
    for k in range(p.trees):
        chance = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, weight, 1)
        g, h = w * (chance - y), w * chance * (1 - chance)
        rows = np.ones(len(y), bool) if used is None else used[k]

        def grow(at, depth, g=g, h=h, k=k, rows=rows):
            on = at & rows
            gs, hs, best = g[on].sum(), h[on].sum(), (1e-6, None)
            if depth < p.depth:
                for f in range(x.shape[1]):
                    for v in np.unique(x[:, f])[:-1]:
                        left = on & (x[:, f] <= v)
                        right = on & ~left
                        hl, hr = h[left].sum(), h[right].sum()
                        if hl <= 0 or hr <= 0 or min(hl, hr) < p.least_weight:
                            continue
                        gain = pulled(g[left].sum()) ** 2 / (hl + p.lam) + pulled(g[right].sum()) ** 2 / (hr + p.lam) - pulled(gs) ** 2 / (hs + p.lam)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, v))
            leaf = np.where(at, -p.step * pulled(gs) / (hs + p.lam), 0.0)
            if best[1] is None:
                return leaf, True
            f, v = best[1]
            (a, a_leaf), (b, b_leaf) = grow(at & (x[:, f] <= v), depth + 1), grow(at & (x[:, f] > v), depth + 1)
            return (leaf, True) if a_leaf and b_leaf and best[0] < p.gamma else (a + b, False)

        margin = margin + grow(np.ones(len(y), bool), 0)[0]
    return margin


@pytest.mark.parametrize("p", [Trees(depth=2, trees=3, bins=256), Trees(depth=3, trees=2, bins=256, gamma=4.0, alpha=0.7, lam=0.3, least_weight=8.0)])
def test_trees_are_those_of_the_plain_search(table, p):
    x, y, df = table
    (model,), _ = boosting.fitted(df, COLUMNS, [(p, float("inf"))], weight=2.0)
    np.testing.assert_allclose(model.margin(x), plain(x, y, p, 2.0), atol=1e-9)


def test_rows_are_drawn_by_key(table):
    x, y, df = table
    p = Trees(depth=2, trees=2, bins=256, subsample=0.5)
    key = (np.arange(len(y)) // 45 + 1 << 6) | (np.arange(len(y)) % 45 + 1)
    used = [boosting._chance(key, p.seed, k) < 0.5 for k in range(2)]
    assert all(0.45 < u.mean() < 0.55 for u in used) and (used[0] != used[1]).any()
    (model,), _ = boosting.fitted(df, COLUMNS, [(p, float("inf"))], weight=1.0)
    np.testing.assert_allclose(model.margin(x), plain(x, y, p, 1.0, used=used), atol=1e-9)


def test_models_grow_together(spark, table, monkeypatch):
    x, y, df = table
    monkeypatch.setattr(boosting, "REFRESH", 2)  # margins are written meanwhile
    a, b = Trees(depth=2, trees=5, step=0.3), Trees(depth=3, trees=3, columns=0.5)
    ends = (boosting.last_key(20), boosting.last_key(25, 10))
    both, losses = boosting.fitted(df, COLUMNS, [(a, ends[0]), (b, ends[1])], 1.0, [(ends[0], boosting.last_key(30)), (ends[1], boosting.last_key(30))])
    alone = [boosting.fitted(df, COLUMNS, [m], 1.0)[0][0] for m in ((a, ends[0]), (b, ends[1]))]
    for m, o in zip(both, alone, strict=True):
        np.testing.assert_allclose(m.margin(x), o.margin(x), atol=1e-12)
    for m, first, loss in zip(both, (20 * 45, 24 * 45 + 10), losses, strict=True):
        p = 1 / (1 + np.exp(-m.margin(x[first:])))
        assert loss == pytest.approx(-np.mean(np.log(np.where(y[first:] == 1, p, 1 - p))))
    monkeypatch.setattr(boosting, "DIRECT", 0)  # sums come together on executors
    np.testing.assert_allclose(boosting.fitted(df, COLUMNS, [(a, ends[0])], 1.0)[0][0].margin(x), both[0].margin(x), atol=1e-12)


def test_compiled_trees(table):
    x, _, df = table
    (model,), _ = boosting.fitted(df, COLUMNS, [(Trees(depth=3, trees=4), float("inf"))])
    got = df.select("pos", "number", model.score().alias("s")).orderBy("pos", "number").toPandas().s
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-model.margin(x))), atol=1e-12)
    again = boosting.Ensemble.from_json(model.to_json())
    np.testing.assert_allclose(again.margin(x), model.margin(x), atol=1e-15)
    said = model.importances()
    assert sum(said.values()) == pytest.approx(1) and min(said["a"], said["b"]) > max(said["c"], said["d"])
    with pytest.raises(ValueError):
        Trees(subsample=0)


def test_one_label_and_constant_columns(spark):
    df = spark.createDataFrame([(1, n, 1.0, 0.0, None) for n in range(1, 46)], "pos long, number int, a double, label double, b double")
    (model,), _ = boosting.fitted(df, ["a", "b"], [(Trees(trees=2, depth=2), float("inf"))])
    assert {t.feature.max() for t in model.trees} == {-1} and (model.margin(np.ones((1, 2))) < 0).all()


def planted(t):
    return (t["x"] - 0.3) ** 2 + 0.5 * (np.log10(t["y"]) + 2) ** 2 + 0.02 * abs(t["k"] - 6) + 0.05 * np.sin(20 * t["x"])


def test_parzen_search_beats_chance():
    space = {"x": search.Range(-2, 2), "y": search.Range(1e-4, 1, log=True), "k": search.Range(1, 10, whole=True)}
    ours, chance = [], []
    for seed in range(12):
        found = search.minimised(planted, space, 50, seed)
        assert len(found.tried) == 50 and all(space[n].low <= v <= space[n].high for t, _ in found.tried for n, v in t.items()) and all(isinstance(t["k"], int) for t, _ in found.tried)
        ours.append(found.best[1])
        r = np.random.default_rng(seed + 100)
        chance.append(min(planted({k: v.value(r.uniform(*v.ends)) for k, v in space.items()}) for _ in range(50)))
    assert np.median(ours) < 0.6 * np.median(chance) and sum(a < b for a, b in zip(ours, chance, strict=True)) >= 9


def test_rolling_folds():
    folds = ml.rolling_folds(51, 8, 3)  # 360 rows, 90 a fold
    rows = [(p << 6) | n for p in range(51, 59) for n in range(1, 46)]
    assert [(rows.index(a) + 1, rows.index(b) + 1) for a, b in folds] == [(90, 180), (180, 270), (270, 360)]
    assert [(rows[:100].index(a) + 1) for a, _ in ml.rolling_folds(51, 2, 2)] == [30, 60]


def test_search_over_rows(spark, table, tmp_path):
    _, _, df = table
    space = {"depth": search.Range(1, 3, whole=True), "trees": search.Range(1, 3, whole=True), "step": search.Range(0.05, 0.5, log=True)}
    params, found = ml.searched(df, 3, 2, 7, space, COLUMNS)
    assert len(found.tried) == 3 and found.best[1] == min(c for _, c in found.tried) and params.depth == found.best[0]["depth"]
    assert found.best[1] < np.log(2)
    ml.save_search(found, str(tmp_path / "s"), spark)
    assert json.loads(spark.read.text(str(tmp_path / "s")).first()[0])["best"] == found.best[0]


def test_the_ranker(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, sorted(r.sample(range(1, 46), 6)), None) for i in range(1, 71)]
    df = spark.createDataFrame(rows, "round long, c array<int>, bonus int")
    m = boosting.kept(scores.features(df, hidden=False))
    params = Trees(depth=2, trees=2)
    model = ml.cached_model(spark, str(tmp_path / "m"), 70, "w", lambda: ml.train(m.filter("pos <= 65"), params))
    again = ml.cached_model(spark, str(tmp_path / "m"), 70, "w", lambda: pytest.fail("not from the cache"))
    assert again.to_json() == model.to_json() and set(model.columns) == set(scores.FEATURES)
    e = ml.evaluated(ml.predicted(again, m.filter("pos > 65 AND pos <= 70")))
    assert e.first().rounds == 5 and 0 <= e.first().hit_15 <= 6
    assert ml.positive_weight(m.filter("pos <= 70")) == pytest.approx(6.5) and ml.known(m).agg(F.max("pos")).first()[0] == 70
    other = spark.createDataFrame([(2.0, 9.0, 22.0)], "hit_15 double, hit_20 double, mean_rank double")
    said = {x.metric: x for x in ml.compared(e, other).collect()}
    assert said["hit_20"].better == "weights" and said["mean_rank"].difference == pytest.approx(e.first().mean_rank - 22)
    ranked = ml.next_round(df, str(tmp_path / "m"), "w").collect()
    assert sorted(x.number for x in ranked) == list(range(1, 46)) and [x.score for x in ranked] == sorted((x.score for x in ranked), reverse=True)
    told = ml.for_document(df, params, model=model)
    doc = json.loads(serve.document(df, "A", n_samples=200, trees=told).first().document)["trees"]
    assert doc["scores"] == pytest.approx([x.score for x in sorted(ranked, key=lambda x: x.number)])
    assert boosting.Ensemble.from_json(doc["model"]).to_json() == model.to_json() and sum(doc["importances"].values()) == pytest.approx(1)


def test_columns_share_bytes_and_few_trees_are_read_again(table, monkeypatch):
    """Sums are made by byte, not by column, and a job goes through few trees beside its own (finding F1)."""
    r, sizes = np.random.default_rng(2), [12, *[2] * 7, 6, 64, 6, 8, 64, 57, 45, 5, 64, *[2] * 6, 53, 43, 63, 64, 7]
    layout = boosting.Layout(sizes)
    assert len(layout.groups) <= 11 and sorted(f for g in layout.groups for f in g) == list(range(28))
    bins = np.stack([r.integers(0, k, 500) for k in sizes], 1)
    codes, g = layout.codes(bins), r.normal(size=500)
    node = r.integers(0, 3, 500)
    joint = [np.stack([np.stack([np.bincount(c[node == i], v[node == i], n) for v in (g, g * g)], 1) for i in range(3)]) for c, n in zip(codes, layout.cells, strict=True)]
    got = layout.columns(layout.spread(joint))
    for f, k in enumerate(sizes):
        want = [[[v[(node == i) & (bins[:, f] == b)].sum() for v in (g, g * g)] for b in range(k)] for i in range(3)]
        np.testing.assert_allclose(got[:, f, :k], want, atol=1e-9)
    t = boosting.Tree.of_depth(4)
    for i in (0, 1, 2, 4, 5, 9, 11):
        t.feature[i], t.bin[i] = r.integers(0, 28), r.integers(0, 2)
    assert (layout.ends(t, codes) == t.node(bins, t.bin)).all()
    assert (layout.ends(boosting.Tree.of_depth(4), codes) == 0).all()
    x, _, df = table
    again, plain = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda rows, tasks, growing, *a: again.append(len(growing[0].finished) - growing[0].written) or plain(rows, tasks, growing, *a))
    (model,), _ = boosting.fitted(df, COLUMNS, [(Trees(depth=1, trees=12), float("inf"))], 2.0)
    assert len(model.trees) == 12 and max(again) < 5
