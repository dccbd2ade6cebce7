"""Blocked theta joins against brute force; nulls, ties, repeated rows, empty sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.operators import near

SCHEMA = "id long, owner long, yr long, grp long, v array<double>"


def _claims(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[5] = v[9]
    rows = [(i, i // 3, 2000 + i % 7, i % 4, v[i].tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block_rows", [7, 4096])
@pytest.mark.parametrize("per_owner", [False, True])
def test_later_pairs(spark, block_rows, per_owner):
    rows, df = _claims(spark)
    found = near.near(df, df, near.later, 0.4, per_owner=per_owner, block_rows=block_rows).cache()
    all_pairs = {}
    for i, o, y, _, v in rows:
        for j, p, z, _, w in rows:
            if z > y and p != o:
                all_pairs[i, j] = (p, float(np.dot(v, w)))
    got = near.reaching(found)
    if per_owner:
        want = {}
        for (i, _), (p, s) in all_pairs.items():
            if s >= 0.4:
                want[i, p] = max(s, want.get((i, p), -2))
        have = {(r.i, r.owner): r.sim for r in got.groupBy("i", "owner").agg(F.max("sim").alias("sim")).collect()}
    else:
        want = {k: s for k, (_, s) in all_pairs.items() if s >= 0.4}
        have = {(r.i, r.j): r.sim for r in got.collect()}
        assert got.count() == len(want)
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in want)
    best = {}
    for (i, _), (_, s) in all_pairs.items():
        best[i] = max(s, best.get(i, -2))
    have = {r.i: r.best for r in near.nearest(found).collect()}
    assert have.keys() == best.keys() and all(abs(have[k] - best[k]) < 1e-12 for k in best)


def test_odd_rows(spark):
    rows = [(1, 1, 2000, 0, [1.0, 0.0]), (2, 2, 2001, 0, [1.0, 0.0]), (2, 2, 2001, 0, [1.0, 0.0]), (3, None, None, None, [1.0, 0.0]), (4, 4, 2002, 0, None), (5, 5, 2002, 0, [1.0, None]), (6, 6, 2002, 0, [float("nan"), 1.0]), (7, 7, 2002, 0, [1.0]), (None, 8, 2002, 0, [1.0, 0.0]), (9, 9, 2002, 0, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.i, r.j) for r in near.reaching(near.near(df.withColumn("side", F.lit(3)), df, near.later, 0.9)).collect())
    assert got == [(1, 2), (1, 2), (3, 1), (3, 2), (3, 2)]
    assert near.near(df.limit(0), df, near.later, 0.9).count() == 0
    assert near.near(df, df.limit(0), near.later, 0.9).count() == 0
