"""The HTTP source against a local server, and configuration files."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from drawstats import config
from drawstats.sources import fetch as source

LAST, FAILS = 9, {5}


class Handler(BaseHTTPRequestHandler):
    seen: set = set()

    def do_GET(self):
        r = int(parse_qs(urlparse(self.path).query)[source.PARAMETER][0])
        if r in FAILS and r not in self.seen:
            self.seen.add(r)
            self.send_error(503)
            return
        rows = [{"ltEpsd": r, **{f"tm{i}WnNo": i + r for i in range(1, 7)}, "bnsWnNo": 45, "ltRflYmd": "20240101"}] if r <= LAST else []
        body = json.dumps({"data": {"list": rows}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_fetch_in_order_with_retries(spark, url):
    got = source.fetched(spark, url, 1, 12, workers="3", delay="0.01").collect()
    assert [r["round"] for r in got] == list(range(1, LAST + 1)) and got[2].n1 == 4


def test_update_fetches_what_is_missing(spark, url):
    exists = lambda r: bool(json.loads(source.fetch(url, r, delay=0.01))["data"]["list"])
    asked = []

    def get(a, b):
        asked.append((a, b))
        return source.fetched(spark, url, a, b).drop("draw_date")

    old = spark.createDataFrame([(r, *range(1, 7), 7, "x") for r in range(1, 7)], "round int, n1 int, n2 int, n3 int, n4 int, n5 int, n6 int, bonus int, memo string")
    got = source.updated(old, exists, get).orderBy("round").collect()
    assert asked == [(7, 9)] and [r["round"] for r in got] == list(range(1, 10)) and got[0].memo == "x" and got[8].memo is None
    with pytest.raises(source.FetchError):
        source.updated(None, exists, get)


def test_unreachable(spark):
    with pytest.raises(source.FetchError):
        source.fetch("http://127.0.0.1:9/", 1, retries=1, delay=0.0, timeout=0.5)


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"recent_n": 10}')
    assert config.load(str(p)).recent_n == 10 and config.load(str(p)).seed == 42
    for bad in ('{"recent_n": 0}', '{"poisson_lambda": 0.6}', '{"other": 1}', "[]", "{", '{"seed": "x"}', '{"min_prob_floor": 1}'):
        p.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(p))
    y = tmp_path / "c.yaml"
    y.write_text("hot_weight: 0.2\n")
    pytest.importorskip("yaml")
    assert config.load(str(y)).hot_weight == 0.2
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.json"))
