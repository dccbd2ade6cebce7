"""Thresholded similarity joins by blocked matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from papyrine.operators.blocks import BLOCK_ROWS, Block, dealt, packed, places, unpacked, usable

META = ("id", "owner")


def _nearest(a: Block, b: Block, threshold: float, cap: int) -> list[np.ndarray]:
    """For each row of ``a`` its ``cap`` nearest rows of ``b`` with another owner, ties to the smaller id: own, near, product."""
    order = np.argsort(b.meta["id"], kind="stable")
    ids, owners = b.meta["id"][order], b.meta["owner"][order]
    sims = np.clip(a.data @ b.data[order].T, -1, 1)
    hit = (sims >= threshold) & (a.meta["owner"][:, None] != owners[None, :])
    x, y = np.nonzero(hit)
    s = sims[x, y]
    first = np.lexsort((y, -s, x))
    x, y, s = x[first], y[first], s[first]
    start = np.searchsorted(x, x)  # where a row's own begin
    keep = np.arange(len(x)) - start < cap
    return [a.meta["id"][x[keep]], ids[y[keep]], s[keep]]


def similar_pairs(claims: DataFrame, threshold: float, cap: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs ``i, j, sim`` (i < j) of claims ``id, owner, v`` of different owners.

    A pair stays if its cosine (of unit vectors) reaches ``threshold`` and either
    side has the other among its ``cap`` nearest, ties by id. Blocks meet as
    tiles; a tile gives each of its claims no more than ``cap`` others, so that what is shuffled after it does
    not grow with the number of similar pairs. Rows without id or vector, and
    vectors with null or non-finite components, match nothing; vectors of
    different lengths do not meet.
    """
    rows = usable(claims.select("id", "owner", "v")).dropDuplicates(["id"])
    n = places(rows.count(), block_rows)
    blocks = dealt(packed(rows, META, block_rows=block_rows), "own", n, "other", n)
    tiles = blocks.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "dim", "meta", "data")

    def match(key: tuple, table: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        own = table.column("own").to_pylist()
        blocks_ = [unpacked(*(table.column(c)[i].as_py() for c in ("dim", "meta", "data")), META) for i in range(len(own))]
        found = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        for x, left in enumerate(blocks_):
            for y, right in enumerate(blocks_):
                # Blocks of one place meet in their own tile, others where their places meet, each way round.
                if (same or own[x] != own[y]) and left.data.shape[1] == right.data.shape[1]:
                    found += [_nearest(p, q, threshold, cap) for p in left.parts() for q in right.parts()]
        i, j, s = map(np.concatenate, zip(*found))
        return pa.table({"own": i, "near": j, "sim": s})

    sides = tiles.groupBy("a", "b").applyInArrow(match, "own long, near long, sim double")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("sim"), "near"))
    best = sides.withColumn("rank", rank).where(F.col("rank") <= cap)
    return best.groupBy(F.least("own", "near").alias("i"), F.greatest("own", "near").alias("j")).agg(F.max("sim").alias("sim"))
