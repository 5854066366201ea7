"""Sources: reading, validation, upserts, payloads, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from drawstats.sources import draws as source
from drawstats.streaming.upsert import current, upsert_stream

HEADER = "Round,N1,N2,N3,N4,N5,N6,memo\n"


def write(tmp_path, text, name="h.csv"):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_load_normalises_sorts_and_keeps_columns(spark, tmp_path):
    path = write(tmp_path, HEADER + "3,1,2,3,4,5,6,다\n1,7,8,9,10,11,12,가\n2,13,14,15,16,17,18,나\n")
    df = source.load(spark, path)
    assert df.columns == ["round", "n1", "n2", "n3", "n4", "n5", "n6", "memo"]
    assert [(r.round, r.memo) for r in df.collect()] == [(1, "가"), (2, "나"), (3, "다")]
    assert [r.round for r in source.load(spark, path, recent_n=2).collect()] == [2, 3]
    with pytest.raises(ValueError):
        source.recent(df, 0)


@pytest.mark.parametrize(("text", "rule"), [
    ("round,n1,n2,n3,n4,n5\n1,1,2,3,4,5\n", "n6"), ("round_id,n1,n2,n3,n4,n5,n6\n1,1,2,3,4,5,46\n", "out_of_range"),
    ("round,n1,n2,n3,n4,n5,n6\n1,1,1,3,4,5,6\n", "not_unique"), ("round,n1,n2,n3,n4,n5,n6\n1,x,1,3,4,5,6\n", "not_numeric"),
])
def test_validation_errors(spark, tmp_path, text, rule):
    with pytest.raises(source.DrawError, match=rule):
        source.load(spark, write(tmp_path, text))


def test_upsert_keeps_last_and_columns(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "round int, n1 int, memo string")
    new = spark.createDataFrame([(2, 21), (3, 30)], "round int, n1 int")
    got = {(r.round, r.n1, r.memo) for r in source.upserted(old, new).collect()}
    assert got == {(1, 10, "a"), (2, 21, None), (3, 30, None)}


def test_max_round(spark):
    assert source.max_round(spark.createDataFrame([("3",), ("x",)], "round string")) == 3
    assert source.max_round(spark.createDataFrame([], "round string")) == 0
    with pytest.raises(source.DrawError):
        source.max_round(spark.createDataFrame([("x",)], "round string"))


def test_payload(spark):
    body = {"data": {"list": [{"ltEpsd": 7, **{f"tm{i}WnNo": i for i in range(1, 7)}, "bnsWnNo": 9, "ltRflYmd": "20240101"}]}, "resultCode": None}
    df = spark.createDataFrame([(7, json.dumps(body)), (8, json.dumps(body)), (9, "not json")], "asked int, payload string")
    got = source.parsed_payload(df).collect()
    assert len(got) == 1 and got[0].round == 7 and got[0].n6 == 6 and got[0].bonus == 9 and got[0].draw_date == "20240101"


@pytest.mark.parametrize("last", [0, 1, 2, 37, 64])
def test_latest_round(last):
    assert source.latest_round(lambda r: r <= last) == last


def test_new_rounds(spark):
    assert [r.round for r in source.new_rounds(spark, 3, 6).collect()] == [4, 5, 6]


def test_streaming_upsert(spark, tmp_path):
    schema = "round long, n1 int"
    src, target, check = (str(tmp_path / n) for n in ("src", "target", "check"))
    for rows in ([(1, 5), (2, 6)], [(2, 7), (3, 8)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        upsert_stream(spark, src, schema, target, check).awaitTermination()
    assert {tuple(r) for r in current(spark, target, schema).collect()} == {(1, 5), (2, 7), (3, 8)}


def test_derived_draws_are_valid(spark):
    lines = spark.range(240).select((F.col("id") / 3).cast("long").alias("l_orderkey"), (F.col("id") * 7 % 100).alias("l_partkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"))
    got = source.from_lineitem(lines).collect()
    assert got and all(len(set(r.c)) == 6 and r.bonus not in r.c and r.c == sorted(r.c) for r in got)


def test_what_breaks_the_rules_is_told_by_column(spark):
    rows = [(r, 1, 2, 3, 4, 5, 46 if r % 2 else 6) for r in range(100)] + [(200, 0, 2, 3, 4, 5, 50), (201, 7, 7, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "round int, n1 int, n2 int, n3 int, n4 int, n5 int, n6 int").repartition(3)
    found = source.problems(df)
    assert found["out_of_range", "n6"] == (51, list(range(1, 40, 2))) and found["out_of_range", "n1"] == (1, [200]) and found["not_unique", None] == (1, [201])
    assert set(found) == {("out_of_range", "n1"), ("out_of_range", "n6"), ("not_unique", None)} and source.violations(df).count() == 53
    with pytest.raises(source.DrawError, match=r"out_of_range: n1: 1 rows, rounds \[200\]; n6: 51 rows"):
        source.validated(df)
    assert source.validated(df.filter("round = 0")).count() == 1
