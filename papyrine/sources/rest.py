"""Paged REST listings as a Spark data source (S2, S4), with retries of transient failures."""

from __future__ import annotations

import contextlib
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class QuotaExceeded(RuntimeError):
    """The service refuses further calls; trying again does not help."""


def transient(error: Exception) -> bool:
    """Timeouts, lost connections, 429 and 5xx."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, (TimeoutError, ConnectionError, urllib.error.URLError))


def retried(call: Callable, tries: int = 4, pause: float = 20.0, again: Callable[[Exception], bool] = transient):
    """The call's result; pauses double after each transient failure, the last one and others are raised."""
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except Exception as error:
            if not left or not again(error):
                raise
        time.sleep(pause)
        pause *= 2


class PagedRest(DataSource):
    """``spark.read.format("paged_rest")``: ``id, record`` (JSON text) of each listed record that has an id.

    Options: ``url``; ``queries``, one a line, each a query string and a partition
    of its own; ``limit`` of records a query; ``per_page``; ``results`` and
    ``cursor``, the paths of the records and the next cursor in an answer;
    ``tries``, ``pause`` and ``timeout``. Pages of one query follow each other,
    as each names the next. A 409 answer raises QuotaExceeded.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "id string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.options.get("queries", "").split("\n")]

    def _answer(self, query: str, cursor: str) -> dict:
        fields = urllib.parse.parse_qsl(query) + [("per-page", self.options.get("per_page", "200")), ("cursor", cursor)]
        url = f"{self.options['url']}?{urllib.parse.urlencode(fields)}"

        def call() -> dict:
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", "30"))) as found:
                    return json.load(found)
            except urllib.error.HTTPError as error:
                if error.code == 409:
                    raise QuotaExceeded(url) from error
                raise

        return retried(call, int(self.options.get("tries", "4")), float(self.options.get("pause", "20")))

    def _at(self, answer: dict, option: str, default: str):
        for step in self.options.get(option, default).split("."):
            answer = answer.get(step) if isinstance(answer, dict) else None
        return answer

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        left, cursor = int(self.options.get("limit", str(2**62))), "*"
        while left > 0 and cursor:
            answer = self._answer(partition.value, cursor)
            records = self._at(answer, "results", "results") or []
            for record in records:
                if left > 0 and isinstance(record, dict) and record.get("id"):
                    left -= 1
                    yield str(record["id"]), json.dumps(record, sort_keys=True)
            cursor = self._at(answer, "cursor", "meta.next_cursor") if records else None


@contextlib.contextmanager
def local_service(records: list[dict], field: str, failures: int = 0) -> Iterator[str]:
    """The address of a paged listing on this machine: records by the value of ``field``, the first answers being failures that pass."""
    lock, left = threading.Lock(), [failures]

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            with lock:
                left[0] -= 1
                if left[0] >= 0:
                    return self.send_error(503)
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            own = [r for r in records if r.get(field) == asked.get(field)]
            at, size = 0 if asked["cursor"] == "*" else int(asked["cursor"]), int(asked["per-page"])
            following = str(at + size) if at + size < len(own) else None
            body = json.dumps({"results": own[at : at + size], "meta": {"next_cursor": following}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}/records"
    finally:
        server.shutdown()
