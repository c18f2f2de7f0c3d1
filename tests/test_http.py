"""Paging against a store in this process, which checks limits as a real one does."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from brindle.sources import http as h

ROWS = [(i // 3 * 10, {"app": "a" if i % 2 else "b"}, f"line {i}") for i in range(100)] + [(2000, {"app": "a"}, f"crowd {i}") for i in range(57)] + [(2001, {"app": "b"}, "after")]


class Store(BaseHTTPRequestHandler):
    rows, fail, stray = ROWS, [], False

    def do_GET(self):
        u = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        if u.path == "/away":
            self.send_response(302)
            self.send_header("Location", "http://elsewhere.invalid/x")
            self.end_headers()
            return
        if self.fail:
            self.send_response(self.fail.pop())
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if u.path.endswith("query_range"):
            found = [r for r in sorted(self.rows, key=lambda r: r[0]) if int(q["start"]) <= r[0] < int(q["end"])][: int(q["limit"])]
            if self.stray:
                found.append((10**9, {}, "stray"))
            streams = {}
            for t, s, line in found:
                streams.setdefault(json.dumps(s), []).append([str(t), line])
            data = {"resultType": "streams", "result": [{"stream": json.loads(s), "values": v} for s, v in streams.items()]}
        elif u.path.endswith("/query"):
            data = {"resultType": "vector", "result": [{"metric": {"a": "b"}, "value": [1, "2.5"]}]}
        elif u.path.endswith("/values"):
            data = ["b", "a"]
        else:
            data = [{"x": "1", "y": "2"}, {"x": "3"}]
        body = json.dumps({"status": "success", "data": data}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


@pytest.mark.parametrize("page", [1, 2, 3, 4, 7, 50, 56, 57, 58, 1000])
def test_paging_loses_and_doubles_nothing(url, page):
    got = list(h.Client(url).lines("{}", 0, 3000, page))
    assert sorted(map(repr, got)) == sorted(map(repr, ROWS)) and [t for t, _, _ in got] == sorted(t for t, _, _ in got)
    assert len(list(h.Client(url).lines("{}", 10, 2000, page))) == len([r for r in ROWS if 10 <= r[0] < 2000])


def test_faults(url, monkeypatch):
    monkeypatch.setattr(h, "MAX_LIMIT", 32)
    with pytest.raises(h.Truncated):
        list(h.Client(url).lines("{}", 1990, 3000, 4))
    monkeypatch.setattr(Store, "stray", True)
    with pytest.raises(h.FetchFault, match="outside"):
        list(h.Client(url).lines("{}", 0, 100))
    with pytest.raises(h.FetchFault, match="origin"):
        h.fetch(url + "/away")


def test_repeats(url, monkeypatch):
    waited = []
    monkeypatch.setattr(Store, "fail", [503, 429, 500])
    assert h.fetch(url + "/loki/api/v1/query", sleep=waited.append) and len(waited) == 3
    monkeypatch.setattr(Store, "fail", [500] * 5)
    with pytest.raises(h.FetchFault):
        h.fetch(url + "/x", sleep=waited.append)
    monkeypatch.setattr(Store, "fail", [404])
    with pytest.raises(h.FetchFault, match="404"):
        h.fetch(url + "/x", sleep=waited.append)


def test_answers(url):
    c = h.Client(url)
    assert c.instant("x", 1) == [({"a": "b"}, 2.5)] and c.label_values("app", 0, 1) == ["a", "b"] and c.label_names("{}", 0, 1) == ["x", "y"]


def test_spark_source(spark, url):
    spark.dataSource.register(h.LogStoreSource)
    df = spark.read.format("brindle_logs").options(url=url, query="{}", start_ns=0, end_ns=3000, chunk="500ns", page=5).load()
    assert df.rdd.getNumPartitions() == 6 if hasattr(df, "rdd") else True
    assert sorted((r.ts_ns, r.labels["app"], r.line) for r in df.collect()) == sorted((t, s["app"], x) for t, s, x in ROWS)
