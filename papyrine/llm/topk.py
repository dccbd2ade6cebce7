"""Exact top-k by inner product: tiles of a query block and a shard, lists merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a query block and of a shard at most, and lists that one step of the tree merges.
QUERY_ROWS, SHARD_ROWS, FAN_IN = 2_048, 8_192, 8
#: Vectors whose number of components times their largest square goes beyond this have no products that fit 64 bits for certain.
LARGEST = 2.0**62


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``vec_id, v`` packed into rows ``dim, n, ids, data``: up to ``size`` vectors of one length as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        names = ["dim", "n", "ids", "data"]

        def out(dim: int) -> pa.RecordBatch:
            ids, data = zip(*held.pop(dim))
            ids = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.concatenate(data).tobytes()], pa.binary())], names=names)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                data = flat[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]] if dim else np.zeros((len(at), 0))
                for i in range(0, len(at), size):
                    held.setdefault(dim, []).append((ids[at[i : i + size]], data[i : i + size]))
                    if sum(len(x) for x, _ in held[dim]) >= size:
                        whole_ids, whole = (np.concatenate(x) for x in zip(*held.pop(dim)))
                        held[dim] = [(whole_ids[:size], whole[:size])]
                        yield out(dim)
                        if len(whole_ids) > size:
                            held[dim] = [(whole_ids[size:], whole[size:])]
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, n int, ids binary, data binary")


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers, as int64; they must fit (see :data:`LARGEST`)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query its k highest (score, id) of one shard, ties to the smaller id, without its own id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    if len(c_ids) > 1:  # a row that is there twice counts once
        same = (c_ids[1:] == c_ids[:-1]) & (c[1:] == c[:-1]).all(axis=1)
        c_ids, c = c_ids[np.r_[True, ~same]], c[np.r_[True, ~same]]
    score = _product(q, c)
    n = len(c_ids)
    own = c_ids[None, :] == q_ids[:, None]
    ranked = np.where(own, np.iinfo(np.int64).min, score * n + (n - 1 - np.arange(n))[None, :]) if np.abs(score).max(initial=0) < 2**62 // max(1, n) else None
    out = []
    if ranked is None:
        for i in range(len(q_ids)):
            best = np.lexsort((c_ids, -score[i]))
            out.append([(int(score[i, j]), int(c_ids[j])) for j in best if not own[i, j]][:k])
        return out
    take = min(k, n)
    top = np.argpartition(ranked, n - take, axis=1)[:, n - take :] if take else np.zeros((len(q_ids), 0), int)
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(ranked, top, 1), axis=1), 1)
    for i in range(len(q_ids)):
        at = [j for j in top[i] if not own[i, j]]
        out.append([(int(score[i, j]), int(c_ids[j])) for j in at])
    return out


def top_k(rows: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "v", query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each row where ``is_query`` holds.

    Vectors hold whole numbers as doubles. Null ids, null vectors and vectors
    with a null, NaN or infinite component take no part, nor do those beyond
    ``LARGEST``, whose products a long may not hold; vectors of different
    lengths are not compared; the pair of an id and a score counts once, so
    that repeated rows do not fill the lists. Ties go to the smaller id. Fewer
    candidates give fewer ranks; an empty table gives an empty table.
    """
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = good.where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    good = good.where(F.size("v") * F.pow(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)), F.lit(2)) < LARGEST)
    # A shard goes to one of ``salts`` places, a block of queries to each of them. The places grow with the
    # rows, so that each holds a few shards.
    salts = max(8, -(-rows.count() // shard_rows))
    shards = _blocks(good, shard_rows).select("dim", "n", "ids", "data").withColumn("shard", F.monotonically_increasing_id())
    shards = shards.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int"))
    blocks = _blocks(good.where(is_query), query_rows)
    blocks = blocks.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    tiles = shards.join(blocks, ["dim", "salt"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, shard, ids, data, q_ids, q_data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                found = tile_top(q_ids, np.frombuffer(q_data).reshape(len(q_ids), dim), ids, np.frombuffer(data).reshape(len(ids), dim), k)
                top = [[{"s": -s, "i": i} for s, i in x] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array([shard] * len(q_ids), pa.int64()), pa.array(top, pa.list_(pa.struct([("s", pa.int64()), ("i", pa.int64())])))], names=["query_id", "shard", "top"])

    lists = tiles.select("dim", "shard", "ids", "data", "q_ids", "q_data").mapInArrow(score, "query_id long, shard long, top array<struct<s: long, i: long>>")
    # monotonically_increasing_id has the partition in its upper bits and the shard of the partition below.
    lists = lists.withColumn("shard", F.expr("shiftright(shard, 33) + (shard & 8589934591) * 1000003"))
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("top")))), 1, k).alias("top")
    most = shards.sparkSession.sparkContext.defaultParallelism
    for _ in range(max(1, int(np.ceil(np.log(max(FAN_IN, most)) / np.log(FAN_IN))))):
        lists = lists.groupBy("query_id", F.expr(f"shard div {FAN_IN}").alias("shard")).agg(merged)
    lists = lists.groupBy("query_id").agg(merged)
    return lists.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
