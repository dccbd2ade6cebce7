"""Chunks, fuzzy titles, matching, statistics, intents and the REST source."""

import json
import math
import random
import threading
import urllib.parse
from difflib import SequenceMatcher
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from papyrine.functions import intents, statistics
from papyrine.operators import chunks, matching, titles
from papyrine.sources import rest


def test_section_chunks(spark):
    long = "Opening words here.\nIntroduction\n" + "alpha " * 30 + "\nMethod\n" + "beta " * 80 + "\n\n" + "gamma " * 10
    df = spark.createDataFrame([(1, "short", 9), (2, None, 9), (3, long, 9), (4, "", 9), (5, "x" * 900, 9)], "id long, body string, chunk long")
    got = {}
    for r in chunks.section_chunks(df, "id", "body", 55).orderBy("id", "chunk").collect():
        got.setdefault(r["id"], []).append(r)
    assert [r["text"] for r in got[1]] == ["short"] and 2 not in got and got[4][0]["tokens"] == 1
    assert " ".join(r["text"] for r in got[3]).split() == long.split()
    assert len(got[3]) > 2 and all(r["tokens"] <= 55 for r in got[3]) and got[3][0]["text"].endswith("alpha")
    assert [r["tokens"] for r in got[5]] == [225]


def test_fuzzy_titles_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcde fg") for _ in range(rng.randrange(3, 40)))
        if i % 3 and rows:
            t = list(rng.choice(rows)[1] or "a")
            t[rng.randrange(len(t))] = rng.choice("xyz")
            t = "".join(t) + rng.choice(["", " ii"])
        rows.append((i, t, rng.choice([True, False, None])))
    rows += [(90, rows[5][1], None), (91, None, True), (92, "", True)]
    group = {}
    for i, t, p in rows:
        if t:
            group.setdefault(t, []).append((i, p))
    named = sorted((min(i for i, _ in m), t, {p for _, p in m}) for t, m in group.items())
    want = set()
    for n, (i, t, p) in enumerate(named):
        for j, u, q in named[n + 1 :]:
            r = SequenceMatcher(None, t, u).ratio()
            if r >= 0.85 or (r >= 0.75 and ((True in p and False in q) or (False in p and True in q))):
                want.add((i, j, round(r, 9)))
    df = spark.createDataFrame(rows, "id long, title string, preprint boolean")
    assert want
    for block in (5, 512):
        assert {(r["a"], r["b"], round(r["ratio"], 9)) for r in titles.fuzzy_titles(df, block_rows=block).collect()} == want
    assert titles.fuzzy_titles(df.where("id > 90")).count() == 0


def test_matching_ties_caliper_and_nulls(spark):
    rows = [("g", 1, True, 10.0), ("g", 2, True, 10.0), ("g", 3, False, 10.0), ("g", 4, False, 10.0), ("g", 5, True, 1000.0), ("g", 6, False, None), ("h", 7, True, 1.0)]
    df = spark.createDataFrame(rows, "lib string, id long, positive boolean, count double")
    assert {(r["positive"], r["control"]) for r in matching.popularity_matches(df, "lib", 0.5).collect()} == {(1, 3), (2, 4)}


def test_tail_against_binomials(spark):
    for k, total, marked, drawn in [(0, 10, 4, 3), (2, 50, 10, 12), (5, 400, 30, 40), (4, 10, 3, 5), (1, 10, 9, 5)]:
        exact = sum(math.comb(marked, i) * math.comb(total - marked, drawn - i) for i in range(k, min(marked, drawn) + 1)) / math.comb(total, drawn)
        assert statistics.tail(k, total, marked, drawn) == pytest.approx(exact, abs=1e-10)
    df = spark.createDataFrame([(2, 50, 10, 12), (None, 5, 1, 1)], "k int, t int, m int, d int")
    got = [r[0] for r in df.select(statistics.hypergeometric_tail("k", "t", "m", "d")).collect()]
    assert got[0] == pytest.approx(statistics.tail(2, 50, 10, 12)) and got[1] is None


def test_power_has_the_published_figures():
    assert round(statistics.RANKING_TEST.power(88, 15 / 88), 3) == 0.446
    assert statistics.RANKING_TEST.size(15 / 88) == 209
    assert statistics.RANKING_TEST.size(0.0) is None
    for share in (0.03, 0.1, 0.31, 0.5, 0.8):  # the same as a search through all sizes
        every = next((n for n in range(10, 4000) if statistics.RANKING_TEST.power(n, min(share, 1 - share)) >= statistics.POWER), None)
        assert statistics.RANKING_TEST.size(share) == every


def test_intents(spark):
    asked = ["I feel hopeless", "hopeless causes in politics", "should we eat fish", "Ada Lovelace", "suicide rates in adolescents", "graph theory", None, ""]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    q = F.col("q")
    got = [tuple(r) for r in df.orderBy("i").select(intents.distress(q), intents.advice(q), intents.blocked(q)).collect()]
    assert got == [(True, False, False), (False, False, False), (False, True, False), (False, False, True), (False, False, True), (False, False, False), (False, False, False), (False, False, False)]


def test_retried_doubles_and_gives_up():
    seen = []

    def call():
        seen.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        rest.retried(call, 3, 0.0)
    assert len(seen) == 3
    with pytest.raises(ValueError):
        rest.retried(lambda: int("x"), 3, 0.0)


@pytest.fixture
def service():
    state = {"failures": 2}

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            if q.get("kind") == "quota":
                return self.send_error(409)
            if state["failures"]:
                state["failures"] -= 1
                return self.send_error(503)
            at = 0 if q["cursor"] == "*" else int(q["cursor"])
            found = [{"id": f"{q['kind']}{at + i}"} if (at + i) % 4 else {"id": None} for i in range(int(q["per-page"]))]
            body = json.dumps({"results": found, "meta": {"next_cursor": str(at + len(found)) if at < 10 else None}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/works"
    server.shutdown()


def test_paged_rest(spark, service):
    spark.dataSource.register(rest.PagedRest)
    read = spark.read.format("paged_rest").option("url", service).option("per_page", "5").option("pause", "0")
    got = sorted(r["id"] for r in read.option("queries", "kind=a\nkind=b").load().collect())
    assert got == sorted(f"{k}{i}" for k in "ab" for i in range(15) if i % 4)
    assert read.option("queries", "kind=c").option("limit", "4").load().count() == 4
    with pytest.raises(Exception, match="QuotaExceeded"):
        read.option("queries", "kind=quota").load().collect()
