"""The best terms of each document against the SQL, on odd rows and with few terms that all tasks know."""

import random

import duckdb
import pytest

from papyrine.operators import terms
from papyrine.plans import wording

COLUMNS = ["doc_id", "term", "bigram", "weight", "place"]


@pytest.mark.parametrize("known", [0, 40, 1 << 18])
def test_top_terms_of_odd_rows(spark, tmp_path, monkeypatch, known):
    monkeypatch.setattr(terms, "KNOWN", known)
    monkeypatch.setattr(terms, "COUNTED", 50)
    monkeypatch.setattr(terms, "ROWS", 30)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10 ** rng.randint(1, 3)):02d}x" for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 30, 200]))) for _ in range(60)] * 2
    rows = [*enumerate(texts), (3, "again THE same id, w01x w02x"), (3, None), (None, "lost W01X w02x w03x"), (None, "w01x w02x lost"), (900, None), (901, ""), (902, "a bc é-ü"), (903, "one"), (904, "Two two")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({wording.SQL['w3_top_terms']})").fetchall()
    got = [tuple(r) for r in wording.QUERIES["w3_top_terms"](spark, str(tmp_path)).select(*COLUMNS).collect()]
    assert len(want) > 2000 and sorted(got, key=repr) == sorted(want, key=repr)


def test_top_terms_of_an_empty_table(spark):
    assert terms.top_terms(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_task_hands_on_a_row_a_term(spark):
    docs = spark.createDataFrame([(i, "some words that all the documents have") for i in range(400)], "doc_id long, text string").coalesce(1)
    counted = terms._frequencies(terms._by_id(docs, "text"))
    assert {r["df"] for r in counted.collect()} == {400} and counted.count() == 7 + 6
