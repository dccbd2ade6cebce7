"""Joins of sets by similarity, against all pairs; how much near duplicates and vector queries hand on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.operators import dedup, near, sets

PAPER = "id string, doi string, title string, year long, surnames array<string>, venue string, citations long, reviewed boolean, refs array<long>, abstract string"


@pytest.mark.parametrize("tile_rows", [4_096, 7])
def test_similar_sets_equal_all_pairs(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(sets, "TILE_ROWS", tile_rows)
    rng = random.Random(5)
    digest = lambda: rng.getrandbits(64) - (1 << 63)
    rows = []
    for block in "xyz":
        words = [digest() for _ in range(30)]
        for i in range(40):
            own = rng.sample(words, rng.randint(1, 12)) if i % 4 else rows[-1][2][:-1] + [digest()] if rows else words[:3]
            rows.append((block, f"{block}{i:02d}", list(dict.fromkeys(own))))
    big = [digest() for _ in range(3000)]
    rows += [("x", "xa", big), ("x", "xb", big[:1501]), ("x", "xc", big[:1499]), ("x", "xd", []), ("x", "xe", None)]
    df = spark.createDataFrame(rows, "block string, id string, set array<long>")
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = sorted((x[1], y[1], like(x[2], y[2])) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] and y[2] and like(x[2], y[2]) >= 0.5)
    assert ("xa", "xb") in {x[:2] for x in want} and ("xa", "xc") not in {x[:2] for x in want}
    assert sorted(map(tuple, sets.similar_sets(df, 0.5).collect())) == want
    assert sets.similar_sets(df.limit(0), 0.5).count() == 0


def test_a_title_of_many_texts_makes_no_row_a_pair(spark, monkeypatch):
    """The pairs of classes that share a title were rows, compared one by one with their abstracts."""
    n = 120
    rows = [(f"p{i:03d}", None, "the same seven words of one title", 2000 + i % 2, ["li"], None, 0, False, [], " ".join(f"w{i}x{k}" for k in range(9))) for i in range(n)] + [("q", None, "the same seven words of one title", 2000, ["li"], None, 0, False, [], "w0x0 w0x1 w0x2 w0x3 w0x4 w0x5 w0x6")]
    handed = []
    monkeypatch.setattr(dedup, "_compared", lambda pairs, own, f=dedup._compared: handed.append(pairs.count()) or f(pairs, own))
    got = dedup.near_duplicates(spark.createDataFrame(rows, PAPER)).collect()
    assert [(r["a"], r["b"], r["title_jaccard"], r["abstract_jaccard"]) for r in got] == [("p000", "q", 1.0, 7 / 9)]
    assert handed == [0]


def _claims(spark, n, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8))
    v[1::7] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, i // 5, 2000 + i % 12, int(i % 3), v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, owner long, yr long, grp long, v array<double>"), rows, v


def test_percentile_of_products_equals_all_pairs(spark):
    """the products were rows of one aggregate."""
    df, rows, v = _claims(spark, 90, 1)
    sims = v @ v.T
    want = np.array([sims[a[0], b[0]] for a in rows for b in rows if a[1] != b[1]])
    for share in (0.0, 0.5, 0.99, 1.0):
        assert near.percentile(df, df, near.other_owner, share, block_rows=16) == pytest.approx(np.quantile(want, share), abs=1e-12)
    assert near.percentile(df.limit(0), df, near.other_owner, 0.5) is None


def test_nearest_in_draws_equals_all_pairs(spark):
    """a row for each pair and draw."""
    df, rows, v = _claims(spark, 90, 2)
    marked = df.withColumn("grp", F.col("id") % 8)
    sims = v @ v.T
    want = {}
    for a in rows:
        for b in rows:
            if b[2] < a[2] and a[1] != b[1]:
                for k in range(3):
                    if b[0] % 8 >> k & 1:
                        want[a[0], k + 1] = max(want.get((a[0], k + 1), -2.0), sims[a[0], b[0]])
    got = {(r["i"], r["draw"]): r["best"] for r in near.nearest_in_draws(df, marked, near.earlier, 3, block_rows=16).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_limiter_adds_what_is_live_in_order(spark, tmp_path):
    """costs taken off a running sum left its rounding error, so that an event that meets the limit exactly was refused."""
    from papyrine.streaming import events

    costs = [14.5, 56.77, 54.18, 2.8, 93.02]
    rows = [(1, k, cost, s * 1_000_000) for k, (cost, s) in enumerate(zip(costs, (0, 1, 50_000, 50_001, 86_402)))]
    spark.createDataFrame(rows, "user_id long, event_id long, value double, us long").select("user_id", "event_id", "value", F.timestamp_micros("us").alias("ts")).write.parquet(f"file://{tmp_path}/e.parquet")
    _, path = events.run_to_table(events.rate_limited(events.read_events(spark, f"file://{tmp_path}/e.parquet"), 150.0, 86_400), "limited")
    assert costs[0] + costs[1] + costs[2] + costs[3] - costs[0] - costs[1] + costs[4] > 150 >= costs[2] + costs[3] + costs[4]
    assert {r["event_id"]: r["admitted"] for r in spark.read.parquet(path).collect()} == {k: True for k in range(5)}


def test_rounds_as_the_sql_does(spark):
    """Spark rounds the printed digits, DuckDB the product."""
    import duckdb

    from papyrine.plans.dialect import Duck, Spark

    rows = [(k * 1e-2 / 10000, c) for k in range(-3000, 90000, 7) for c in (0.5, 0.3, 0.7)] + [(float("nan"), 0.5), (1e300, 0.5), (None, 0.5)]
    df = spark.createDataFrame(rows, "s double, c double")
    got = [r[0] for r in df.selectExpr("s", "c", f"{Spark.round('s * c', 6)} AS r").coalesce(1).select("r").collect()]
    con = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame({"i": range(len(rows)), "s": [r[0] for r in rows], "c": [r[1] for r in rows]})  # noqa: F841
    want = [r[0] for r in con.execute(f"SELECT {Duck.round('s * c', 6)} FROM frame ORDER BY i").fetchall()]
    assert list(map(repr, got[:-3])) == list(map(repr, want[:-3]))
    assert [r[0] for r in df.selectExpr("round(s * c, 6)").collect()][:-3] != want[:-3]
