"""Exact joins of sets by Jaccard similarity, inside blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows and members of a block that meet in one task (more of them meet as tiles), bits of a signature, pairs whose signatures are compared and members that are counted at once.
TILE_ROWS, TILE_MEMBERS, BITS, AT_ONCE, COUNTED = 4_096, 700_000, 4_096, 1 << 16, 1 << 18


def _signatures(sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` bits for each set: the parity of the number of members that fall on a bit."""
    words = BITS // 64
    odd = np.zeros((len(sizes), words), np.uint64)
    np.bitwise_xor.at(odd, (np.repeat(np.arange(len(sizes)), sizes), (flat >> np.uint64(6)).astype(np.int64) % words), np.uint64(1) << (flat & np.uint64(63)))
    return odd


def similar(sizes: np.ndarray, flat: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets of Jaccard similarity ``least`` or more (over 0): their indices and the similarity.

    ``flat`` has the members (distinct in a set, spread evenly over 64 bits) of sets of ``sizes`` one after another.
    Two sets differ in at least as many members as their signatures in bits; pairs
    that this does not rule out are counted. With ``side``, only sets of different sides meet. Empty sets match nothing.
    """
    flat = flat.view(np.uint64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(order) > 1:
        dense = np.unique(flat, return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(flat), bool)
        size = sizes[order]
        by_width = {BITS // 64: _signatures(sizes, flat)[order]}
        for width in (BITS // 64 >> k for k in range(1, (BITS // 64).bit_length())):
            by_width[width] = by_width[2 * width][:, :width] ^ by_width[2 * width][:, width:]
    differ = 1 - 2 * least / (1 + least)  # at most this share of both sizes
    done = 0
    while done < len(order) > 1:
        lo = int(np.searchsorted(size, least * size[done] - 1e-6))
        end = min(len(order), done + max(1, AT_ONCE // (done - lo + 1)))
        width = 1
        while width < BITS // 64 and width * 64 < 4 * size[end - 1]:
            width *= 2
        x, y = by_width[width][done:end], by_width[width][lo:end]
        apart = np.zeros((len(x), len(y)), np.uint16)
        for k in range(width):
            apart += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
        may = (apart <= differ * (size[done:end, None] + size[None, lo:end]) + 1e-6) & (np.arange(lo, end)[None, :] < np.arange(done, end)[:, None])
        if side is not None:
            may &= side[order[done:end], None] != side[None, order[lo:end]]
        for r in np.flatnonzero(may.any(axis=1)):
            i, near = order[done + r], order[lo + np.flatnonzero(may[r])]
            own = dense[starts[i] : starts[i] + sizes[i]]
            mark[own] = True
            for part in np.split(near, np.flatnonzero(np.diff(np.cumsum(sizes[near]) // COUNTED)) + 1):
                some = sizes[part]
                ends = np.cumsum(some)
                at = np.repeat(starts[part] - (ends - some), some) + np.arange(ends[-1])
                common = np.add.reduceat(mark[dense[at]].astype(np.int32), ends - some)
                like = common / (sizes[i] + some - common)
                hit = like >= least
                if hit.any():
                    found.append((np.full(hit.sum(), i), part[hit], like[hit]))
            mark[own] = False
        done = end
    i, j, like = (np.concatenate(x) for x in zip(*found))
    return i, j, like


def similar_sets(rows: DataFrame, least: float) -> DataFrame:
    """Pairs ``i, j, like`` (i < j) of rows ``block, id, set`` of one block whose sets have a Jaccard similarity of ``least`` or more (over 0).

    ``block`` and ``id`` are strings, a set is an array of distinct 64-bit digests; two members with one digest count as
    the same. The table is read more than once and should be a written one. Blocks meet whole
    or as tiles, small ones many to a task. Empty and null sets match nothing.
    """
    used = rows.where(F.size("set") > 0)
    own = used.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.size("set")).alias("m")).where("n > 1")
    own = own.select("block", F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("m") / TILE_MEMBERS)).alias("tiles"), "m")
    shipped = own.agg(F.sum(F.col("m") * F.col("tiles"))).first()[0]
    buckets = max(1, -(-(shipped or 0) // TILE_MEMBERS))
    tiled = used.join(own, "block").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.select("block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id", "set")

    def match(table: pa.Table) -> pa.Table:
        sets, ids, blocks = (table.column(c).combine_chunks() for c in ("set", "id", "block"))
        code = blocks.dictionary_encode().indices.to_numpy()
        a, b, tile = (table.column(c).to_numpy() for c in ("a", "b", "tile"))
        order = np.lexsort((b, a, code))
        code, a, b = code[order], a[order], b[order]
        edges = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo, hi in zip(edges[:-1], edges[1:]):
            here = order[lo:hi]
            own = sets.take(pa.array(here))
            i, j, like = similar(np.diff(own.offsets.to_numpy()).astype(np.int64), own.flatten().to_numpy(), None if a[lo] == b[lo] else tile[here], least)
            found.append((here[i], here[j], like))
        i, j, like = (np.concatenate(x) for x in zip(*found))
        return pa.table({"i": ids.take(pa.array(i)), "j": ids.take(pa.array(j)), "like": like})

    dealt = tiled.groupBy(F.pmod(F.xxhash64("block", "a", "b"), F.lit(buckets)).alias("bucket"))
    return dealt.applyInArrow(match, "i string, j string, like double").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "like").where("i < j")
