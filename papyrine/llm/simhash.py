"""SimHash fingerprints and exact near pairs among them by vantage-point trees.

A fingerprint pair within ``RADIUS`` = 3 bits differs in at most one bit in one
of its two 32-bit halves. For each half a vantage-point tree over the Hamming
distance of that half, a metric, therefore needs radius 1 only: a node splits
its points by their distance to a vantage point at the median, and by the
triangle inequality only points on the boundary (distance equal to the median)
can be near to a point beyond it. Those go to both sides. The upper levels of
the trees are built from a sample that grows with the rows and deal the fingerprints out to
shards; in its shard a task goes on with the same splits and compares the
points of each small leaf by all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from papyrine.operators.components import connected_components
from papyrine.shared import drop, keep

RADIUS = 3
#: Rows aimed at in a shard, rows of a leaf, and sampled rows for each shard, from which the upper levels are built.
SHARD_ROWS, LEAF_ROWS, SAMPLE_OF_SHARD = 2_048, 256, 8
#: Levels of the upper trees at most: the driver then has a sample of 32 MB, and shards grow beyond 10 ** 9 different fingerprints.
MOST_LEVELS = 19
#: Rows of a fingerprint from which its component is sent to the rows instead of the rows to it: so many, or this share of all.
HOT_ROWS, HOT_SHARE = 100_000, 1e-5
SEED = 42
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingles' digests, repeats included; 0 without any."""
    counts, block = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), block):
        counts += np.unpackbits(hashes[i : i + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without a word."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(b" ".join(words), SEED)
        return int(np.frombuffer(hashes, ">u8")[0])
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    block = 1 << 16
    for i in range(0, len(starts), block):
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[i : i + block], ends[i : i + block])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` for each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _split(values: np.ndarray, mask: np.uint64, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point, of a few, that splits most evenly, and the median distance."""
    best, found = len(values) * 0.9, None
    for at in rng.integers(0, len(values), 6):
        d = np.bitwise_count((values ^ values[at]) & mask)
        cut = int(np.median(d))
        largest = max((d <= cut).sum(), (d >= cut).sum())
        if largest < best:
            best, found = largest, (values[at], cut)
    return found


def shard_tree(sample: np.ndarray, half: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and cuts of a heap: the children of node i are 2i+1 (d <= cut) and 2i+2 (d >= cut); a cut of -1 has none."""
    rng = np.random.default_rng(SEED + half)
    vantage, cut = np.zeros(2**depth - 1, np.uint64), np.full(2**depth - 1, -1, np.int8)
    parts = {0: sample}
    for i in range(len(cut)):
        values = parts.pop(i, None)
        if values is None or len(values) < 8 or not (found := _split(values, HALVES[half], rng)):
            continue
        vantage[i], cut[i] = found
        d = np.bitwise_count((values ^ found[0]) & HALVES[half])
        parts[2 * i + 1], parts[2 * i + 2] = values[d <= found[1]], values[d > found[1]]
    return vantage, cut


def deal(values: np.ndarray, tree: tuple[np.ndarray, np.ndarray], half: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the value and shard, for each shard that the value belongs to or whose boundary it touches; a level at once."""
    vantage, cut = tree
    at, node = np.arange(len(values)), np.zeros(len(values), np.int64)
    rows, shards = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        inner = node < len(cut)
        inner[inner] = cut[node[inner]] >= 0
        rows.append(at[~inner])
        shards.append(node[~inner])
        at, node = at[inner], node[inner]
        d, c = np.bitwise_count((values[at] ^ vantage[node]) & HALVES[half]), cut[node]
        near, far = d <= c, d >= c
        at, node = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
    return np.concatenate(rows), np.concatenate(shards)


def _joined(a: np.ndarray) -> np.ndarray:
    """For each value of a block the index of the first one that it is linked to, through others as well."""
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= RADIUS
    label = np.where(near, np.arange(len(a))[None, :], len(a)).min(axis=1)
    while True:
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def stars(values: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct values that connect all that are near by this half: (value, first of its group)."""
    rng = np.random.default_rng(SEED)
    src, dst = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    todo = [(np.unique(values), HALVES[half], 1)]
    while todo:
        part, mask, radius = todo.pop()
        if len(part) > LEAF_ROWS:
            found = None
            for at in rng.integers(0, len(part), 4):
                d = np.bitwise_count((part ^ part[at]) & mask)
                cut = int(np.median(d))
                for c in (cut, cut - 1):
                    size = max((d <= c).sum(), (d > c - radius).sum())
                    if size < 0.9 * len(part) and (found is None or size < found[0]):
                        found = (size, d, c)
            if found:
                _, d, c = found
                todo += [(part[d <= c], mask, radius), (part[d > c - radius], mask, radius)]
                continue
            if mask != ALL_BITS:  # values that hardly differ in this half are told apart by all bits
                todo.append((part, ALL_BITS, RADIUS))
                continue
        for i in range(0, len(part), LEAF_ROWS):
            for j in range(i, len(part), LEAF_ROWS):
                block = part[i : i + LEAF_ROWS] if i == j else np.concatenate([part[i : i + LEAF_ROWS], part[j : j + LEAF_ROWS]])
                label = _joined(block)
                linked = label != np.arange(len(block))
                src.append(block[linked])
                dst.append(block[label[linked]])
    return np.concatenate(src), np.concatenate(dst)


def near_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Links ``src, dst`` between distinct fingerprints whose components are those of all pairs within 3 bits.

    ``distinct`` is read three times and should be a written table. A group of
    n near fingerprints gives about n links for each leaf that it lies in, not
    all its pairs.
    """
    values = distinct.select(F.col(fp).alias("fp")).where("fp IS NOT NULL")
    rows = values.count()
    depth = min(max(0, int(np.ceil(np.log2(max(1, rows / SHARD_ROWS))))), MOST_LEVELS)
    # About SAMPLE_OF_SHARD fingerprints for each shard, those of smallest hash, whatever the order of the rows.
    share = min(1.0, (SAMPLE_OF_SHARD << depth) / max(1, rows)) if depth else 0.0
    few = values.where(F.xxhash64("fp") < int((share - 0.5) * 2**64)) if share < 1 else values
    sample = np.sort(few.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64) if depth else np.zeros(0, np.uint64)
    trees = [shard_tree(sample, half, depth) for half in (0, 1)]

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                at, shard = deal(own, trees[half], half)
                yield pa.RecordBatch.from_arrays([pa.array(shard * 2 + half), pa.array(own[at].view(np.int64))], names=["shard", "fp"])

    def in_shard(key: tuple, table: pa.Table) -> pa.Table:
        src, dst = stars(table.column("fp").to_numpy().view(np.uint64), key[0].as_py() % 2)
        return pa.table({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    dealt = values.mapInArrow(to_shards, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(in_shard, "src long, dst long").distinct()


def near_components(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest doc_id among the rows whose fingerprints
    are linked by steps of at most 3 bits. Null and empty texts have
    fingerprint 0 and are linked like any other; rows without doc_id keep their
    links but name no component (a component of such rows alone is null);
    repeated rows come back as often. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    own = keep(fingerprints(docs, text, width), "fingerprints")
    distinct = keep(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    comps = connected_components(near_links(distinct)).select(F.col("node").alias("fp"), "component")
    named = distinct.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = keep(named.join(least, "component").select("fp", "component_id", "n"), "component-of")
    # A fingerprint that many rows have would fill one task: its component goes to its rows. There are 1 / HOT_SHARE such at most.
    total = distinct.agg(F.sum("n")).first()[0] or 0
    drop(spark, distinct)
    hot = F.broadcast(of_fp.where(F.col("n") >= max(HOT_ROWS, HOT_SHARE * total)).select("fp", "component_id"))
    many = own.join(hot, "fp")
    few = own.join(hot, "fp", "left_anti").join(of_fp.select("fp", "component_id"), "fp")
    return many.unionByName(few).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
