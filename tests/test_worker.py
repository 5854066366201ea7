"""The worker's order of filters, against a plain loop."""

from pyspark.sql import functions as F

from drawstats.functions import combos
from drawstats.plans import serve

DRAWS = [[1, 12, 23, 30, 34, 45], [3, 7, 19, 24, 32, 41], [2, 9, 20, 27, 33, 44]]
CASES = [
    [1, 2, 3, 4, 5, 6], [40, 41, 42, 43, 44, 45], [1, 3, 25, 27, 35, 43], [2, 4, 26, 28, 36, 44], [23, 24, 25, 26, 27, 28],
    [8, 11, 20, 27, 33, 44], [3, 7, 19, 24, 32, 41], [3, 7, 19, 24, 32, 40], [2, 9, 20, 25, 36, 41], [5, 15, 25, 26, 31, 44],
    [4, 13, 21, 26, 35, 43], [4, 13, 21, 26, 35, 43], [1, 2, 10, 11, 40, 41], [10, 13, 17, 29, 36, 38],
]


def _plain(c, preset, near):
    x = preset.limits
    zones = [sum(a <= v <= b for v in c) for a, b in combos.ZONES]
    endings = [sum(v % 10 == d for v in c) for d in range(10)]
    ac = len({b - a for a in c for b in c if b > a}) - 5
    tests = [
        ("sum", x.sum_low <= sum(c) <= x.sum_high), ("odd_even", x.odd[0] <= sum(v % 2 for v in c) <= x.odd[1]), ("high_low", x.high[0] <= sum(v >= 23 for v in c) <= x.high[1]),
        ("ac", ac >= x.min_ac), ("zone", max(zones) <= x.zone_max), ("ending", max(endings) <= x.tail_max), ("excluded", not set(preset.excluded) & set(c)),
        ("rare_pair", not preset.rare or not any({a, b} <= set(c) for a, b in combos.RARE_PAIRS)), ("carryover", len(set(c) & set(near)) <= preset.carry_limit),
        ("history", all(len(set(c) & set(d)) < 5 for d in DRAWS)),
    ]
    return next((name for name, ok in tests if not ok), "passed")


def test_first_failure_in_the_order_of_the_worker(spark):
    draws = spark.createDataFrame([(i + 1, c, 10) for i, c in enumerate(DRAWS)], "round long, c array<int>, bonus int")
    drawn = spark.createDataFrame(list(enumerate(CASES)), "sample_id long, c array<int>")
    met = set()
    for preset in serve.PRESETS.values():
        for near in ([4, 13, 21, 26], []):
            got = {r.sample_id: r.failed_filter for r in serve.rejected_by(drawn, preset, near, draws).collect()}
            assert got == {i: _plain(c, preset, near) for i, c in enumerate(CASES)}
            met |= set(got.values())
    assert {"sum", "odd_even", "excluded", "history", "carryover", "passed"} <= met


def test_no_draws_and_no_candidates(spark):
    none = spark.createDataFrame([], "round long, c array<int>, bonus int")
    drawn = spark.createDataFrame(list(enumerate(CASES)), "sample_id long, c array<int>")
    assert serve.rejected_by(drawn, serve.PRESETS["B"], [], none).filter("failed_filter = 'history'").count() == 0
    assert serve.rejected_by(drawn.filter(F.lit(False)), serve.PRESETS["A"], [], none).count() == 0
