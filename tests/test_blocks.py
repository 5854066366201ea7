"""Positions, trailing statistics and features over several blocks of rounds, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawstats.operators import blocks, hmm, scores

BLOCK = 1 << blocks.BLOCK_BITS


@pytest.fixture(scope="module")
def long_history(spark):
    """Sparse round ids over many cells; 7 is drawn through a whole block and beyond, 45 only at first and last."""
    r = random.Random(5)
    rows, at = [], 0
    for i in range(2 * BLOCK + 90):
        at += r.choice([1, 1, 2, 40])
        c = {7} if 100 <= i < 100 + BLOCK + 200 else set()
        c |= {45} if i in (0, 2 * BLOCK + 80) else set()
        while len(c) < 6:
            x = r.randint(1, 44)
            if x != 7 or i % 9 == 0:
                c.add(x)
        rows.append((at, sorted(c), None))
    return rows, spark.createDataFrame(rows, "round long, c array<int>, bonus int").repartition(5).cache()


def test_positions(spark, long_history):
    rows, df = long_history
    got = {p.pos: p for p in blocks.positions(df).collect()}
    assert sorted(got) == list(range(1, len(rows) + 2))
    for i, (r, c, _) in enumerate(rows):
        p = got[i + 1]
        assert p["round"] == r and p.c == c and p["last"] == (rows[i - 1][1] if i else None) and p.before == (rows[i - 2][1] if i > 1 else None)
    end = got[len(rows) + 1]
    assert end["round"] == rows[-1][0] + 1 and end.c is None and end["last"] == rows[-1][1]


def test_positions_of_odd_tables(spark):
    schema = "round long, c array<int>, bonus int"
    assert [(p.pos, p["round"], p.c) for p in blocks.positions(spark.createDataFrame([], schema)).collect()] == [(1, 1, None)]
    far = [(-5, [1, 2, 3, 4, 5, 6], 7), (10**12, [2, 3, 4, 5, 6, 7], 8), (3, [3, 4, 5, 6, 7, 8], 9)]
    got = sorted((p.pos, p["round"]) for p in blocks.positions(spark.createDataFrame(far, schema)).collect())
    assert got == [(1, -5), (2, 3), (3, 10**12), (4, 10**12 + 1)]


def test_sums_before(spark):
    r = random.Random(2)
    n = {r.randrange(-3000, 10**7): r.randrange(5) for _ in range(3000)}
    got = {x.k: x.before for x in blocks.sums_before(spark.createDataFrame(list(n.items()), "k long, v long"), "k", "v").collect()}
    total = 0
    for k in sorted(n):
        assert got[k] == total
        total += n[k]


def test_no_window_over_all_rows(spark, long_history):
    _, df = long_history
    for plan in (blocks.positions(df), scores.statistics(df), scores.features(df, hidden=False)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in "\n".join(line for line in text.split("\n") if "Window" in line)
        assert not [line for line in text.split("\n") if "Window [" in line and "windowspecdefinition(pos" in line]


def longest_run(hits):
    best = run = 0
    for x in hits:
        run = run + 1 if x else 0
        best = max(best, run)
    return best


def test_features_over_blocks(spark, long_history):
    rows, df = long_history
    draws, ids = [set(c) for _, c, _ in rows], [r for r, _, _ in rows]
    asked = [51, 60, BLOCK - 1, BLOCK, BLOCK + 1, BLOCK + 2, BLOCK + 60, 2 * BLOCK, 2 * BLOCK + 1, 2 * BLOCK + 2, len(rows), len(rows) + 1]
    got = {(r.pos, r.number): r for r in scores.features(df, hidden=False).filter(F.col("pos").isin(asked)).collect()}
    assert len(got) == 45 * len(asked)
    for t in asked:
        prior, rounds = draws[: t - 1], ids[: t - 1]
        last = prior[-1]
        base = {n: (1 + sum(n in d for d in prior[-50:])) / 52 for n in range(1, 46)}
        weight = {n: sum(i + 1 for i, d in enumerate(prior) if n in d) for n in range(1, 46)}
        move, total = {}, {}
        for a, b in zip(prior, prior[1:], strict=False):
            for p in a & last:
                total[p] = total.get(p, 0) + 6
                for q in b:
                    move[p, q] = move.get((p, q), 0) + 1
        for n in (1, 7, 8, 23, 44, 45):
            r, hits = got[t, n], [n in d for d in prior]
            at = [x for x, h in zip(rounds, hits, strict=True) if h]
            gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
            f = [sum(hits[-k:]) / (6 * k) for k in (10, 20, 50)]
            assert r.base_score == pytest.approx(base[n]) and r.hot_boost == (sum(hits[-5:]) >= 2) and r.cold_boost == (not any(hits[-10:]))
            assert r.frequency_recent_10 == pytest.approx(f[0]) and r.frequency_recent_20 == pytest.approx(f[1]) and r.frequency_variance == pytest.approx(np.var(f))
            assert r.frequency_all == pytest.approx(sum(hits) / (6 * len(prior))) and r.streak_length == pytest.approx(longest_run(hits) / 10)
            assert r.gap_since_last == pytest.approx((rounds[-1] - (at[-1] if at else 0)) / rounds[-1])
            assert r.gap_variance == pytest.approx(np.var(gaps) if len(gaps) > 1 else 0, abs=1e-6) and r.recency_score == pytest.approx(weight[n] / max(weight.values()))
            assert r.rank_percentile == pytest.approx(sum(b < base[n] - 1e-12 for b in base.values()) / 45)
            assert r.markov_penalty == pytest.approx(0.3 * sum(move.get((p, n), 0) / total[p] for p in last if p in total) / 6)
            assert r.pair_freq_recent == pytest.approx(sum(n in d and bool(d & last) for d in prior[:-1]) / (len(prior) - 1))
            assert r.lag_1_appeared == hits[-1] and r.lag_2_appeared == hits[-2] and r.label == (t <= len(rows) and n in draws[t - 1])


def test_recent_transitions_over_blocks(spark, long_history):
    rows, df = long_history
    draws = [set(c) for _, c, _ in rows]
    got = {r.pos: r.m for r in scores.followers(df, 50).filter(F.col("pos").isin(30, BLOCK, BLOCK + 1, BLOCK + 20)).collect()}
    for t, m in got.items():
        prior = draws[: t - 1][-50:]
        last = prior[-1]
        for n in range(1, 46):
            shares = []
            for p in last:
                follow = [b for a, b in zip(prior, prior[1:], strict=False) if p in a]
                shares.append(sum(n in b for b in follow) / (6 * len(follow)) if follow else 0)
            assert m[n - 1] == pytest.approx(sum(shares) / 6)


# ---------------------------------------------------------------- hidden states


def plain_state(x, rounds=hmm.ROUNDS):
    """One sequence at a time, with loops over states."""
    symbols = 2 if max(x) else 1
    start, move, emit = (a.tolist() for a in hmm.initial(symbols))
    s, last = range(hmm.STATES), -np.inf
    for _ in range(rounds):
        forward, scale = [], []
        for t, v in enumerate(x):
            at = [(start[j] if t == 0 else sum(forward[-1][i] * move[i][j] for i in s)) * emit[j][v] for j in s]
            scale.append(sum(at))
            forward.append([a / scale[-1] for a in at])
        back = [[1.0] * hmm.STATES]
        for t in range(len(x) - 1, 0, -1):
            back.insert(0, [sum(move[i][j] * emit[j][x[t]] * back[0][j] for j in s) / scale[t] for i in s])
        gamma = [[f * b for f, b in zip(ft, bt, strict=True)] for ft, bt in zip(forward, back, strict=True)]
        pairs = [[sum(forward[t - 1][i] * move[i][j] * emit[j][x[t]] * back[t][j] / scale[t] for t in range(1, len(x))) for j in s] for i in s]
        norm = lambda a: [v / sum(a) if sum(a) else 0.0 for v in a]
        start, move = norm(gamma[0]), [norm(p) for p in pairs]
        emit = [norm([sum(g[j] for g, v in zip(gamma, x, strict=True) if v == k) for k in range(symbols)]) for j in s]
        said = float(np.log(scale).sum())
        if said - last < hmm.GAIN:
            break
        last = said
    with np.errstate(divide="ignore"):
        lm, le, score = np.log(move), np.log(emit), np.log(start) + np.log([e[x[0]] for e in emit])
    for v in x[1:]:
        score = (score[:, None] + lm).max(0) + le[:, v]
    order = sorted(s, key=lambda j: -emit[j][1] if symbols == 2 else 0)
    state = int(score.argmax())
    return hmm.HOT if state == order[0] else hmm.COLD if state == order[-1] else hmm.NEUTRAL


def test_many_fits_are_those_of_single_ones():
    r = np.random.default_rng(4)
    x = (r.random((60, 12)) < r.random(12) * 0.6).astype(np.int8)
    x[:, 0], x[:, 1], x[:, 2] = 0, 1, 0
    assert hmm.states_of_sequences(x).tolist() == [plain_state(c.tolist()) for c in x.T]
    assert hmm.states_of_sequences(x[:19]).tolist() == [hmm.NEUTRAL] * 12  # too short
    lengths = np.array([30, 60, 45, 22, 60, 19, 0, 33, 60, 51, 20, 47])
    want = [plain_state(c[:n].tolist()) if n >= hmm.LEAST else hmm.NEUTRAL for c, n in zip(x.T, lengths, strict=True)]
    assert hmm.states_of_sequences(x, lengths).tolist() == want
    said = hmm.Fit(x, 2).said
    for a, b in zip(said, said[1:], strict=False):
        on = ~np.isnan(b)
        assert (b[on] >= a[on] - 1e-9).all()


def test_states_as_of_every_round(spark, long_history):
    rows, df = long_history
    few = df.filter(F.col("round") <= rows[139][0])
    got = {r.pos: r.states for r in hmm.states_as_of(few, 15).collect()}
    assert sorted(got) == list(range(16, 142))
    for t in (16, 20, 21, 64, 65, 101, 130, 141):
        window = rows[: t - 1][-hmm.WINDOW :]
        for n in (1, 7, 30, 45):
            x = [int(n in c) for _, c, _ in window]
            assert got[t][n - 1] == (plain_state(x) if len(x) >= hmm.LEAST else hmm.NEUTRAL), (t, n)
    last = {r.number: r.state for r in hmm.states(few).collect()}
    assert [last[n] for n in range(1, 46)] == [str(hmm.NAMES[s]) for s in got[141]]


def test_states_in_the_matrix(spark, long_history):
    rows, df = long_history
    few = df.filter(F.col("round") <= rows[69][0])
    states = {r.pos: r.states for r in hmm.states_as_of(few).collect()}
    m = scores.features(few).collect()
    assert len(m) == 21 * 45 and len(scores.FEATURES) == 28
    assert all((r.hmm_hot_prob, r.hmm_cold_prob) == (states[r.pos][r.number - 1] == hmm.HOT, states[r.pos][r.number - 1] == hmm.COLD) for r in m)


def test_models_stay_side_by_side_in_memory(monkeypatch):
    """The arrays of a fit's rounds have the sequences last and close together, few or many, and those that ended make room (findings F4, F5, F6)."""
    x, kept = (np.random.default_rng(5).random((60, 90)) < 0.2).astype(np.int8), []
    plain = hmm.Fit._round
    monkeypatch.setattr(hmm.Fit, "_round", staticmethod(lambda *a: kept.append(a) or plain(*a)))
    whole = hmm.Fit(x, 2)
    assert all(a.flags.c_contiguous for call in kept for a in call if a is not None)
    monkeypatch.setattr(hmm, "WIDTH", 16)
    narrow = hmm.Fit(x, 2)
    assert max(call[0].shape[1] for call in kept[-len(narrow.said) :]) <= 16
    for a, b in ((whole.start, narrow.start), (whole.move, narrow.move), (whole.emit, narrow.emit)):
        np.testing.assert_array_equal(a, b)
    np.testing.assert_array_equal(np.array(whole.said), np.array(narrow.said))


def test_steps_are_runs_of_rounds(monkeypatch):
    """A fit goes through runs of absences and draws, not through rounds, and they tell the whole sequence (findings F2, F3)."""
    r = np.random.default_rng(6)
    x = (r.random((100, 300)) < 6 / 45).astype(np.int8)
    x[:, 0], x[:, 1], x[1:60, 2], x[1:, 3] = 0, 1, 0, 0
    lengths = r.integers(20, 101, 300)
    lengths[:4] = 100
    steps = hmm.steps_of(x, lengths)
    for k in range(300):
        told = [x[0, k]]
        for s in steps[:, k]:
            told += [0] * s + [1] if s < hmm.DRAWN else [0] * hmm.RUNS[s - hmm.DRAWN] if s < hmm.NONE else []
        assert told == x[: lengths[k], k].tolist()
    assert (steps[:, 4:] != hmm.NONE).sum(0).mean() < 0.35 * lengths[4:].mean()
    assert hmm.states_of_sequences(x[:, :8], lengths[:8]).tolist() == [plain_state(c[:n].tolist()) for c, n in zip(x.T[:8], lengths[:8], strict=True)]
    gone, plain = [], hmm.Fit._round
    monkeypatch.setattr(hmm.Fit, "_round", staticmethod(lambda *a: gone.append(len(a[0])) or plain(*a)))
    hmm.Fit(x[:, 4:], 2)
    assert max(gone) < 50
