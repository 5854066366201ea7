"""The range table, the stream of payloads and the pool of results, over restarts and failures."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from drawstats.sources import fetch
from drawstats.sources.draws import DrawError, parsed_payload
from drawstats.streaming.pool import EVENTS, serve_stream
from drawstats.streaming.table import RangeTable
from drawstats.streaming.upsert import current, upsert_stream

SCHEMA = "round long, n1 int"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_ranges_are_rewritten(spark, tmp_path):
    t = RangeTable(spark, str(tmp_path / "t"), SCHEMA, bits=4)
    assert t.read().count() == 0 and t.upsert(spark.createDataFrame([], SCHEMA)) == set()
    assert len(t.upsert(spark.range(200).selectExpr("id AS round", "cast(id AS int) AS n1"))) == 13
    before = files(tmp_path)
    assert t.upsert(spark.range(40, 50).selectExpr("id AS round", "-1 AS n1")) == {"2", "3"}
    after = files(tmp_path)
    assert all(after[f] == before[f] for f in before if "part=2/" not in f and "part=3/" not in f)
    got = {r["round"]: r.n1 for r in t.read().collect()}
    assert got == {r: -1 if 40 <= r < 50 else r for r in range(200)}
    for k in range(3):
        t.upsert(spark.createDataFrame([(40, k)], SCHEMA))
    assert len(t._names("data/part=2")) == 2 and len(t.manifests()) == 2  # the newest and the one before
    assert t.read({"2"}).count() == 16 and len(t._names("data/part=12")) == 1


def test_order_of_arrival_and_repeated_batches(spark, tmp_path):
    t = RangeTable(spark, str(tmp_path / "t"), SCHEMA)
    rows = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (None, 9, 3)], "round long, n1 int, came int")
    with pytest.raises(DrawError):
        t.upsert(rows)
    t.upsert(rows, "came", batch=0)
    t.upsert(spark.createDataFrame([(1, 7, 0)], "round long, n1 int, came int"), "came", batch=0)  # taken in before
    assert [tuple(r) for r in t.read().collect()] == [(1, 5)]
    t.upsert(spark.createDataFrame([(1, 7, 0)], "round long, n1 int, came int"), "came", batch=1)
    assert [tuple(r) for r in t.read().collect()] == [(1, 7)]
    t._commit(99, t.manifest())
    with pytest.raises(DrawError):
        t._commit(99, t.manifest())


def test_the_stream_rewrites_what_it_touches(spark, tmp_path):
    src, target, check = (str(tmp_path / n) for n in ("src", "target", "check"))
    for rows in ([(1, 5), (300, 6)], [(300, 7), (301, 8)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        upsert_stream(spark, src, SCHEMA, target, check).awaitTermination()
    assert {tuple(r) for r in current(spark, target, SCHEMA).collect()} == {(1, 5), (300, 7), (301, 8)}
    assert RangeTable(spark, target, SCHEMA).manifest()["parts"] == {"0": 0, "1": 1}


class Handler(BaseHTTPRequestHandler):
    last, broken, asked = 7, set(), []

    def do_GET(self):
        r = int(parse_qs(urlparse(self.path).query)[fetch.PARAMETER][0])
        self.asked.append(r)
        rows = [{"ltEpsd": r, **{f"tm{i}WnNo": i + r for i in range(1, 7)}, "bnsWnNo": 45, "ltRflYmd": "20240101"}] if r <= self.last else []
        body = b"<html>busy</html>" if r in self.broken else json.dumps({"data": {"list": rows}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    Handler.last, Handler.broken = 7, set()
    Handler.asked.clear()
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_payloads_are_followed_over_restarts(spark, tmp_path, url):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        rows = fetch.payload_stream(spark, url, 3, workers="2", delay="0.01")
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    got = lambda: [r["round"] for r in parsed_payload(spark.read.parquet(out)).orderBy("round").collect()]
    assert got() == [3, 4, 5, 6, 7]
    Handler.last, Handler.broken = 11, {10}
    with pytest.raises(Exception, match="no JSON"):  # a failure loses nothing
        run()
    Handler.broken = set()
    Handler.asked.clear()
    run()
    assert got() == list(range(3, 12)) and min(Handler.asked) >= 8  # what was taken in is not asked for again


def test_answers_that_are_wrong(spark, url):
    Handler.broken = {2}
    with pytest.raises(Exception, match="round 2: the answer is no JSON"):
        fetch.fetched(spark, url, 1, 3, delay="0.01").collect()
    with pytest.raises(fetch.FetchError):
        fetch.decoded("[1]", 5)
    body = lambda r: json.dumps({"data": {"list": [{"ltEpsd": r}]}})
    rows = spark.createDataFrame([(1, body(1)), (2, body(9)), (3, "{}")], "asked int, payload string")
    assert [tuple(r) for r in fetch.mismatched(rows).collect()] == [(2, 9)]
    with pytest.raises(fetch.FetchError, match="2 gave 9"):
        fetch.only_asked(rows)
    assert [r["round"] for r in fetch.only_asked(rows.filter(F.col("asked") != 2)).collect()] == [1]


def test_the_pool(spark, tmp_path):
    events, answers, check = (str(tmp_path / n) for n in ("events", "answers", "check"))
    made = []

    def make(preset, games, samples, seed):
        made.append((preset, games, samples))
        return f"{preset}{games}-{len(made)}"

    def ask(*ids, preset="A", games=5):
        spark.createDataFrame([("request", preset, games, i, None) for i in ids], EVENTS).coalesce(1).write.mode("append").json(f"{events}/asked")
        serve_stream(spark, events, answers, check, make, target=3, most=3).awaitTermination()

    ask(1, 2)
    told = lambda: {r.id: (r.source, r.payload) for r in spark.read.schema(EVENTS + ", source string").json(answers, recursiveFileLookup=True).collect()}
    assert told() == {1: ("bootstrap", "A5-1"), 2: ("bootstrap", "A5-1")} and made == [("A", 5, 6000), ("A", 5, None)]
    ask(3, 4, 5)  # the two results of the first batch come back as events
    assert {k: told()[k] for k in (3, 4, 5)} == {3: ("pool", "A5-1"), 4: ("pool", "A5-2"), 5: ("pool", "A5-1")}
    ask(6, preset="B", games=10)
    assert told()[6][0] == "bootstrap" and told()[6][1].startswith("B10-")
    ask(7, 8, 9, 10)  # the cursor went on, and the pool is full
    assert [told()[k][0] for k in (7, 8, 9, 10)] == ["pool"] * 4 and len({told()[k][1] for k in (7, 8, 9)}) == 3 and told()[10] == told()[7]
    n = len(made)
    ask(11)
    assert [m for m in made[n:] if m[:2] == ("A", 5)] == []  # nothing is made for a full pool
    with pytest.raises(ValueError):
        serve_stream(spark, events, answers, check, make, target=4, most=3)
