"""Small results: comparisons, status, attempts and documents as files."""

import json

import pytest
from pyspark.sql import functions as F

from drawstats.plans import backtest, serve


def test_compared(spark):
    rounds = lambda hits: spark.createDataFrame([(h,) for h in hits], "hits int")
    model, chance = backtest.summary(rounds([3, 4, 0, 1])), backtest.summary(rounds([0, 3, 0, 1]))
    got = backtest.compared(model, chance).first()
    assert (got.p3_diff, got.p4_diff, got.mean_hits_diff) == pytest.approx((0.25, 0.25, 1.0))
    same = backtest.compared(chance, backtest.summary(rounds([]))).first()
    assert (same.p3_diff, same.p4_diff, same.mean_hits_diff) == pytest.approx((0.25, 0.0, 1.0))


@pytest.mark.parametrize(("rate", "top_k", "want"), [(1.0, 10, 8000), (0.05, 300, 18000), (0.0, 300, 45000), (0.001, 3000, 60000), (0.02, 300, 45000)])
def test_attempts(spark, rate, top_k, want):
    assert spark.range(1).select(serve.attempts(F.lit(rate), top_k).alias("n")).first().n == want


def test_status(spark):
    rows = [("A", 5, 0), ("A", 5, 0), ("A", 5, 1), ("B", 10, 7)]
    got = serve.status(spark.createDataFrame(rows, "preset string, games int, variant_id int")).collect()
    assert {(r.preset, r.games): r.variants for r in got} == {("A", 5): 2, ("B", 10): 1}


def test_documents_are_files(spark, tmp_path):
    made = {n: spark.createDataFrame([(json.dumps({"name": n}),)], "document string") for n in ("a", "b")}
    for _ in range(2):  # written again, they are replaced
        serve.write_documents(made, str(tmp_path))
    assert [json.loads(r[0])["name"] for n in ("a", "b") for r in spark.read.text(f"{tmp_path}/{n}").collect()] == ["a", "b"]
