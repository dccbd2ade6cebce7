"""Vectors packed into blocks of bytes, and tiles in which two blocks meet.

A block is one row, whatever its number of vectors, so that a shuffle moves
bytes and not arrays. Blocks are cut from partitions as they come: which rows share a
block does not follow from any key, so that no key makes a large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a block (8192 vectors of 64 doubles take 4 MB), and rows that are multiplied at once.
BLOCK_ROWS, TILE_ROWS = 8_192, 2_048


@dataclass
class Block:
    """Vectors of one length with whole numbers beside them."""

    meta: dict[str, np.ndarray]
    data: np.ndarray

    def parts(self) -> Iterator["Block"]:
        for i in range(0, len(self.data), TILE_ROWS):
            yield Block({k: x[i : i + TILE_ROWS] for k, x in self.meta.items()}, self.data[i : i + TILE_ROWS])


def usable(rows: DataFrame, vector: str = "v", key: str = "id") -> DataFrame:
    """Rows with a key and a vector without null or non-finite components; vectors as doubles."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(key).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False))).withColumn(vector, v)


def packed(rows: DataFrame, meta: tuple[str, ...], vector: str = "v", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``dim, meta, data`` for up to ``block_rows`` rows each: their numbers and vectors as bytes. Null numbers read as -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
            numbers, data = (np.concatenate(x, axis=-1 - k) for k, x in enumerate(zip(*held.pop(dim))))
            full = len(data) // block_rows * block_rows if whole else len(data)
            for i in range(0, full, block_rows):
                part = slice(i, i + block_rows)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.ascontiguousarray(numbers[:, part]).tobytes()], pa.binary()), pa.array([data[part].tobytes()], pa.binary())], names=["dim", "meta", "data"])
            if full < len(data):
                held[dim] = [(numbers[:, full:], data[full:])]

        for batch in batches:
            numbers = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(meta))]) if batch.num_rows else np.zeros((len(meta), 0), np.int64)
            lists = batch.column(len(meta))
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((numbers[:, at], flat[starts[at][:, None] + np.arange(dim)]))
                if sum(len(x) for _, x in held[dim]) >= block_rows:
                    yield from out(dim, True)
        for dim in list(held):
            yield from out(dim, False)

    return rows.select(*(F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in meta), vector).mapInArrow(run, "dim int, meta binary, data binary")


def unpacked(dim: int, meta: bytes, data: bytes, names: tuple[str, ...]) -> Block:
    vectors = np.frombuffer(data).reshape(-1, dim) if dim else np.zeros((len(meta) // (8 * len(names)), 0))
    return Block(dict(zip(names, np.frombuffer(meta, np.int64).reshape(len(names), -1))), vectors)


def places(rows: int, block_rows: int) -> int:
    """Places that blocks of so many rows are dealt to, about a block each."""
    return max(1, -(-rows // block_rows))


def dealt(blocks: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Blocks at one place of their own side, and at every place of the other."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_own)).cast("int")
    return blocks.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
