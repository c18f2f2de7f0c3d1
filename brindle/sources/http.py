"""A log store over HTTP as a Spark source: chunks of time are partitions, read by paging that neither loses nor doubles a line.

    spark.dataSource.register(LogStoreSource)
    spark.read.format("brindle_logs").options(url=..., query='{app="a"}', start_ns=..., end_ns=..., chunk="1h").load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.logql.syntax import duration_ns

NS = 10**9
#: The largest answer that is read, the pauses before a GET is repeated, and the most lines that one timestamp is asked for.
MAX_BYTES = 512 * 1024 * 1024
PAUSES = (1.0, 4.0, 16.0)
MAX_LIMIT = 1 << 20


class FetchFault(RuntimeError):
    """The store gave no usable answer."""


class Truncated(FetchFault):
    """One timestamp holds more lines than may be asked for at once."""


class _SameOrigin(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        a, b = urllib.parse.urlsplit(req.full_url), urllib.parse.urlsplit(newurl)
        if (a.scheme, a.netloc) != (b.scheme, b.netloc):
            raise FetchFault(f"redirected to another origin: {b.netloc}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str, headers: dict[str, str] | None = None, timeout: float = 60, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """GET with repeats: on lost connections, 429 and 5xx, after the pauses or what Retry-After says (a minute at most). Redirects stay within the origin."""
    opener = urllib.request.build_opener(_SameOrigin)
    for pause in (*PAUSES, None):
        try:
            with opener.open(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
                data = r.read(MAX_BYTES + 1)
            if len(data) > MAX_BYTES:
                raise FetchFault("the answer is too large")
            return data
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or pause is None:
                raise FetchFault(f"HTTP {e.code}: {e.read(300).decode('utf-8', 'replace')}") from e
            after = e.headers.get("Retry-After", "")
            sleep(min(float(after), 60.0) if after.isdigit() else pause)
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            if pause is None:
                raise FetchFault(str(e)) from e
            sleep(pause)
    raise AssertionError


class Client:
    def __init__(self, url: str, headers: dict[str, str] | None = None, get: Callable[[str, dict[str, str] | None], bytes] = fetch):
        self.url, self.headers, self.get = url.rstrip("/"), headers, get

    def call(self, path: str, **args: object) -> object:
        try:
            answer = json.loads(self.get(f"{self.url}{path}?{urllib.parse.urlencode(args)}", self.headers))
        except ValueError as e:
            raise FetchFault("the answer is no JSON") from e
        if not isinstance(answer, dict) or answer.get("status") != "success":
            raise FetchFault(f"the store answered {str(answer)[:200]}")
        return answer.get("data")

    def page(self, query: str, start: int, end: int, limit: int) -> list[tuple[int, dict, str]]:
        """Up to `limit` oldest lines of [start, end), in order. A line outside is a fault."""
        data = self.call("/loki/api/v1/query_range", query=query, start=start, end=end, limit=limit, direction="forward")
        rows = [(int(t), s.get("stream") or {}, line) for s in data["result"] for t, line in s["values"]]
        for t, _, _ in rows:
            if not start <= t < end:
                raise FetchFault(f"a line at {t} lies outside of what was asked for")
        return sorted(rows, key=lambda r: (r[0], sorted(r[1].items())))

    def lines(self, query: str, start: int, end: int, page: int = 5000) -> Iterator[tuple[int, dict, str]]:
        """All lines of [start, end). Pages end between timestamps: the last timestamp of a full page is read again, by itself where it fills a page."""
        while start < end:
            rows = self.page(query, start, end, page)
            if len(rows) < page:
                yield from rows
                return
            last = rows[-1][0]
            if rows[0][0] < last:
                yield from (r for r in rows if r[0] < last)
                start = last
                continue
            limit = page
            while len(rows) >= limit:
                limit *= 2
                if limit > MAX_LIMIT:
                    raise Truncated(f"more than {MAX_LIMIT} lines at {last}")
                rows = self.page(query, last, last + 1, limit)
            yield from rows
            start = last + 1

    def instant(self, query: str, at_ns: int) -> list[tuple[dict, float]]:
        return [(s.get("metric") or {}, float(s["value"][1])) for s in self.call("/loki/api/v1/query", query=query, time=at_ns)["result"]]

    def label_values(self, name: str, start: int, end: int) -> list[str]:
        return sorted(self.call(f"/loki/api/v1/label/{urllib.parse.quote(name, safe='')}/values", start=start, end=end) or [])

    def label_names(self, query: str, start: int, end: int) -> list[str]:
        return sorted({k for s in self.call("/loki/api/v1/series", **{"match[]": query, "start": start, "end": end}) or [] for k in s})


class _Chunk(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        missing = {"url", "query", "start_ns", "end_ns"} - {k.lower() for k in options}
        if missing:
            raise ValueError(f"options missing: {sorted(missing)}")
        self.o = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Chunk]:
        start, end, step = int(self.o["start_ns"]), int(self.o["end_ns"]), duration_ns(self.o.get("chunk", "24h"))
        return [_Chunk(a, min(a + step, end)) for a in range(start, end, step)] or [_Chunk(start, start)]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        client = Client(self.o["url"], json.loads(self.o.get("headers", "{}")))
        for t, labels, line in client.lines(self.o["query"], partition.start, partition.end, int(self.o.get("page", "5000"))):
            yield labels, t, line


class LogStoreSource(DataSource):
    """Options: url, query, start_ns, end_ns; chunk (a duration, 24h), page (5000), headers (a JSON map)."""

    @classmethod
    def name(cls) -> str:
        return "brindle_logs"

    def schema(self) -> str:
        return "labels map<string,string>, ts_ns bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
