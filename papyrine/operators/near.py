"""Theta joins over vectors by blocked matrix products (J2, J3, J15, J16, and the joins of R2 to R5 and V3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from papyrine.operators.blocks import BLOCK_ROWS, Block, dealt, packed, places, unpacked, usable
from papyrine.shared import drop, keep

#: Matrix of pairs that may match, from the columns ``id, owner, yr, grp`` of both sides (left as a column, right as a row).
Allowed = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]

META = ("id", "owner", "yr", "grp")
_LOW = (1 << 63) - 1
RESULT = "i long, owner long, j long, sim double, best boolean"


def later(a: dict, b: dict) -> np.ndarray:
    """The right claim is of another paper and of a later year."""
    return (b["yr"] > a["yr"]) & (b["owner"] != a["owner"])


def earlier(a: dict, b: dict) -> np.ndarray:
    """The right claim is of another paper and of an earlier year."""
    return (b["yr"] < a["yr"]) & (b["owner"] != a["owner"])


def same_group(a: dict, b: dict) -> np.ndarray:
    """Unordered pairs of two papers' claims in one group."""
    return (a["id"] < b["id"]) & (a["owner"] != b["owner"]) & (a["grp"] == b["grp"])


def later_group(a: dict, b: dict) -> np.ndarray:
    """The right claim is of a group that comes after the left one's."""
    return a["grp"] < b["grp"]


def other_owner(a: dict, b: dict) -> np.ndarray:
    """The claims are of two papers."""
    return a["owner"] != b["owner"]


def any_pair(a: dict, b: dict) -> np.ndarray:
    """Any two claims."""
    return (a["id"] == a["id"]) & (b["id"] == b["id"])


def near(left: DataFrame, right: DataFrame, allowed: Allowed, threshold: float, *, per_owner: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Allowed pairs of claims ``id, owner, yr, grp, v`` (longs, unit vectors) whose product reaches ``threshold``.

    Gives ``i, owner, j, sim, best``: the left claim, the right one's owner and
    id, the product. With ``per_owner`` a tile gives only the nearest claim of
    each owner (ties to the smaller id), so that owners with many claims are
    reduced before the shuffle. Each tile also gives every left claim's nearest
    allowed claim, marked ``best``, whether or not it reaches the threshold: the
    maximum over these is the exact nearest one (:func:`nearest`); other readers
    leave those rows out (:func:`reaching`).

    Blocks of rows meet as tiles, in which no more than ``TILE_ROWS`` rows of
    either side are multiplied at once; a block goes once to each place of the other
    side, as bytes. Rows with a null id or a null vector, null or non-finite components
    match nothing; null owner, year or group read as -1. Repeated rows come back
    as often. Empty sides give an empty table.
    """

    def match(table: pa.Table) -> pa.Table:
        found = {"i": [np.zeros(0, np.int64)], "owner": [np.zeros(0, np.int64)], "j": [np.zeros(0, np.int64)], "sim": [np.zeros(0)], "best": [np.zeros(0, bool)]}
        for x, y in _met(table):
            for columns in _tile(x, y, allowed, threshold, per_owner):
                for name, column in zip(found, columns):
                    found[name].append(column)
        return pa.table({k: np.concatenate(v) for k, v in found.items()})

    return _tiles(left, right, block_rows).groupBy("a", "b").applyInArrow(match, RESULT)


def _tiles(left: DataFrame, right: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of both sides at the places ``a, b`` where they meet."""
    a, b = (usable(df.select(*META, "v")) for df in (left, right))
    n_a, n_b = (places(x.count(), block_rows) for x in (a, b))
    of = lambda df, side: packed(df, META, block_rows=block_rows).withColumn("side", F.lit(side))
    return dealt(of(a, 0), "a", n_a, "b", n_b).unionByName(dealt(of(b, 1), "b", n_b, "a", n_a))


def _met(table: pa.Table) -> Iterator[tuple[Block, Block]]:
    """Parts of the two sides of a tile that have a product."""
    sides: tuple[list[Block], list[Block]] = ([], [])
    for r in range(table.num_rows):
        sides[table.column("side")[r].as_py()].append(unpacked(*(table.column(c)[r].as_py() for c in ("dim", "meta", "data")), META))
    for x in (part for block in sides[0] for part in block.parts()):
        for y in (part for block in sides[1] for part in block.parts()):
            if x.data.shape[1] == y.data.shape[1]:  # vectors of different length have no product
                yield x, y


def _products(x: Block, y: Block, allowed: Allowed) -> tuple[np.ndarray, np.ndarray]:
    """All products of two parts, and which are of allowed pairs."""
    shape = (len(x.data), len(y.data))
    return x.data @ y.data.T, np.broadcast_to(allowed({c: m[:, None] for c, m in x.meta.items()}, {c: m[None, :] for c, m in y.meta.items()}), shape)


def nearest_in_draws(left: DataFrame, right: DataFrame, allowed: Allowed, draws: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``i, draw, best``: the highest product of each left claim with the allowed right claims of each draw that has one.

    Bit k of a right claim's ``grp`` says whether draw k + 1 has it. A tile gives one row a left claim
    and draw, whatever the number of pairs.
    """

    def match(table: pa.Table) -> pa.Table:
        found = {"i": [np.zeros(0, np.int64)], "draw": [np.zeros(0, np.int64)], "best": [np.zeros(0)]}
        for x, y in _met(table):
            sims, ok = _products(x, y, allowed)
            sims = np.where(ok, sims, -np.inf)
            for k in range(draws):
                own = np.flatnonzero(y.meta["grp"] >> k & 1)
                top = sims[:, own].max(axis=1, initial=-np.inf)
                r = np.flatnonzero(top > -np.inf)
                for name, column in zip(found, (x.meta["id"][r], np.full(len(r), k + 1), top[r])):
                    found[name].append(column)
        return pa.table({k: np.concatenate(v) for k, v in found.items()})

    each = _tiles(left, right, block_rows).groupBy("a", "b").applyInArrow(match, "i long, draw long, best double")
    return each.groupBy("i", "draw").agg(F.max("best").alias("best"))


def percentile(left: DataFrame, right: DataFrame, allowed: Allowed, share: float, block_rows: int = BLOCK_ROWS) -> float | None:
    """The exact percentile of the products of all allowed pairs, between two of them by proportion; None without a pair.

    The products are not kept: their bits, as whole numbers in the same order, are counted by the
    first 20, then within the ones that have the place by 20 more, then whole. The blocks
    are written once, so that every round multiplies the same ones.
    """
    tiles = keep(_tiles(left, right, block_rows), "product-tiles")

    def counted(within: list[int], before: int, shift: int) -> list[tuple[int, int]]:
        def match(table: pa.Table) -> pa.Table:
            first = np.zeros(1 << 20, np.int64)
            rest = [np.zeros(0, np.int64)]
            for x, y in _met(table):
                sims, ok = _products(x, y, allowed)
                bits = (sims[ok] + 0.0).view(np.int64)
                key = bits ^ ((bits >> 63) & _LOW)
                if within:
                    rest.append(key[np.isin(key >> before, within)] >> shift)
                else:
                    first += np.bincount((key >> shift) + (1 << 19), minlength=1 << 20)
            if not within:
                bins = np.flatnonzero(first)
                return pa.table({"bin": bins - (1 << 19), "n": first[bins]})
            bins, n = np.unique(np.concatenate(rest), return_counts=True)
            return pa.table({"bin": bins, "n": n.astype(np.int64)})

        found = tiles.groupBy("a", "b").applyInArrow(match, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
        return sorted(map(tuple, found.collect()))

    bins = counted([], 0, 44)
    total = sum(n for _, n in bins)
    if not total:
        drop(tiles.sparkSession, tiles)
        return None
    place = share * (total - 1)
    left_over = [int(place), min(int(place) + 1, total - 1)]  # of the two places, those in the bins before
    at: list[int | None] = [None, None]
    for before, shift in ((64, 44), (44, 24), (24, 0)):
        if shift < 44:
            bins = counted(sorted(set(at)), before, shift)
        for k in (0, 1):
            for bin_, n in bins:
                if at[k] is None or bin_ >> (before - shift) == at[k]:
                    if left_over[k] < n:
                        at[k] = bin_
                        break
                    left_over[k] -= n
    drop(tiles.sparkSession, tiles)
    lo, hi = np.array([x ^ (_LOW if x < 0 else 0) for x in at], np.int64).view(np.float64).tolist()
    return lo + (hi - lo) * (place - int(place))


def _tile(x: Block, y: Block, allowed: Allowed, threshold: float, per_owner: bool) -> list[list[np.ndarray]]:
    """The pairs of one tile that reach the threshold, and every left row's nearest."""
    order = np.lexsort((y.meta["id"], y.meta["owner"]))
    right = {c: m[order] for c, m in y.meta.items()}
    sims = x.data @ y.data[order].T
    ok = allowed({c: m[:, None] for c, m in x.meta.items()}, {c: m[None, :] for c, m in right.items()})
    sims = np.where(ok, sims, -np.inf)
    owners = right["owner"]
    if per_owner:
        edges = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        tops = np.maximum.reduceat(sims, edges, axis=1)
        r, k = np.nonzero((tops >= threshold) & (tops > -np.inf))
        ends = np.r_[edges[1:], len(owners)]
        c = np.fromiter((edges[o] + sims[i, edges[o] : ends[o]].argmax() for i, o in zip(r, k)), np.int64, len(r))
    else:
        r, c = np.nonzero((sims >= threshold) & ok)
    out = [[x.meta["id"][r], owners[c], right["id"][c], sims[r, c], np.zeros(len(r), bool)]]
    top = sims.max(axis=1)
    r = np.flatnonzero(top > -np.inf)
    if len(r):
        c = np.where(sims[r] == top[r][:, None], right["id"][None, :], np.iinfo(np.int64).max).argmin(axis=1)
        out.append([x.meta["id"][r], owners[c], right["id"][c], top[r], np.ones(len(r), bool)])
    return out


def reaching(found: DataFrame) -> DataFrame:
    """The pairs of :func:`near` that reach the threshold."""
    return found.where("NOT best").drop("best")


def nearest(found: DataFrame) -> DataFrame:
    """``i, best``: the highest product of each left claim that has an allowed partner."""
    return found.where("best").groupBy("i").agg(F.max("sim").alias("best"))
