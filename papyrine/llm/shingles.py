"""Near-duplicate texts: SimHash fingerprints near to each other by vantage-point trees, then exact Jaccard similarity of word shingles.

Texts with the same words are one text. The operator of :mod:`papyrine.llm.simhash`
finds the components of their fingerprints; texts of a component meet in one task, which compares
their whole sets, and those that are similar are a class. Fingerprints of texts of similarity 0.8
differ in more bits than the trees' radius as well. So each text has 128 min-hashes of its set of
shingles, in 32 bands of 4, by which classes meet that the trees left apart: a pair of similarity s shares no band with
probability (1 - s^4)^32, less than 1e-7 from 0.8 on. Where a band has texts of one
class only nothing is compared, bands with the same members are compared once, and within a band texts of a class are not compared
with each other. Trees and bands only propose, so that texts under the threshold are never linked by chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from papyrine.llm import simhash
from papyrine.operators.components import connected_components
from papyrine.llm.text import free_name, words
from papyrine.shared import drop, keep

WIDTH, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS, SEED = 32, 4, 42
#: Shingles hashed at once; texts of a band that meet in one task (more of them meet as tiles).
BLOCK, TILE_ROWS = 1 << 12, 4_096
_RNG = np.random.default_rng(SEED)
FACTORS, OFFSETS = (_RNG.integers(0, 2**63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def text_key(text: str | None) -> int:
    """A signed 64-bit digest of a text's words; two texts that have it are taken as the same."""
    import xxhash

    line = b" ".join((text or "").encode("utf-8", "replace").lower().split())
    return int(np.uint64(xxhash.xxh64_intdigest(line, SEED)).astype(np.int64))


def key_of(text: Column) -> Column:
    """:func:`text_key` as a Spark expression."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.xxhash64(F.array_join(words(lowered), " "))


def digests(text: str | None) -> np.ndarray:
    """64-bit digests of a text's shingles, repeats included; one of all its words if they are fewer, none without a word."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest, n = b" ".join(words), xxhash.xxh64_digest, max(1, len(words) - WIDTH + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist())])
    return np.frombuffer(hashes, ">u8").astype(np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct digests of a text's shingles."""
    return np.unique(digests(text))


def band_keys(own: np.ndarray) -> list[int]:
    """A signed digest of each band of min-hashes of a set; none of an empty set."""
    import xxhash

    if not len(own):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(own), BLOCK):
        least = np.minimum(least, (FACTORS * own[None, i : i + BLOCK] + OFFSETS).min(axis=1))
    found = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(found, np.uint64).view(np.int64).tolist()


def links(sets: list[np.ndarray], classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the indices of sets whose components are those of all pairs of similarity ``SIMILARITY`` or more.

    A set is compared with those that nothing has reached yet, all at once, so
    that a group of n sets that are near to one another costs about n comparisons.
    Sets of one class count as linked already and get no link for it.
    """
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets])
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(universe), np.int64)
    found: list[tuple[int, int]] = []
    left = np.flatnonzero(sizes)
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            if classes is not None:
                known = classes[left] == classes[i]
                todo, left = todo + left[known].tolist(), left[~known]
                if not len(left):
                    break
            own = flat[starts[i] : starts[i] + sizes[i]]
            some = sizes[left]
            at = np.repeat(starts[left] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            mark[own] = 1
            common = np.add.reduceat(mark[flat[at]], np.cumsum(some) - some)
            mark[own] = 0
            near = common >= SIMILARITY * (sizes[i] + some - common)
            found += [(int(i), int(j)) for j in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return found


def tree_groups(distinct: DataFrame) -> DataFrame:
    """``band, n, key, class`` of the texts whose fingerprints the vantage-point trees put into one component; each text is a class."""
    values = keep(distinct.select("fp").distinct(), "fingerprints")
    comps = connected_components(simhash.near_links(values)).select(F.col("node").alias("fp"), "component")
    drop(distinct.sparkSession, values)
    placed = distinct.select("key", "fp").join(comps, "fp", "left").select("key", F.coalesce("component", "fp").alias("band"))
    return placed.join(placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band").select("band", "n", "key", F.col("key").alias("class"))


def band_groups(distinct: DataFrame, classes: DataFrame) -> DataFrame:
    """``band, n, key, class`` of the texts that share a band with one of another class; one of the bands with the same members."""
    classed = distinct.select("key", "bands").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    banded = classed.select("key", "class", F.explode("bands").alias("band")).repartition("band")
    met = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor("key").alias("x"), F.min("key").alias("lo"), F.max("key").alias("hi"), (F.min("class") < F.max("class")).alias("several")).where("several")
    chosen = met.groupBy("n", "x", "lo", "hi").agg(F.min("band").alias("band")).select("band", "n")
    return banded.join(chosen, "band").select("band", "n", "key", "class")


def near_links(members: DataFrame, distinct: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Links ``src, dst`` between the keys of near texts of different classes in a band; ``members`` has ``band, n, key, class``.

    Both it and ``distinct`` are read more than once and should be written tables.
    """
    wanted = distinct.join(members.select("key").distinct(), "key").select("key", "first_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k.as_py(), zlib.compress((t.as_py() or "").encode("utf-8", "replace"), 1)) for k, t in zip(*batch.columns) if text_key(t.as_py()) == k.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([z for _, z in rows], pa.binary())], names=["key", "own"])

    rows = docs.select(F.col("doc_id").alias("first_id"), F.col(text).alias("t"))
    unnamed = rows.where("first_id IS NULL").select(key_of(F.col("t")).alias("key"), "t").join(wanted.where("first_id IS NULL").select("key"), "key")
    texts = rows.join(wanted, "first_id").select("key", "t").unionByName(unnamed)
    whole = texts.mapInArrow(packed, "key long, own binary").dropDuplicates(["key"])
    tiles = F.ceil(F.col("n") / TILE_ROWS)
    tiled = members.join(whole, "key").withColumn("own_tile", F.pmod(F.xxhash64("key"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    tiled = tiled.select("band", F.least("own_tile", "other").alias("a"), F.greatest("own_tile", "other").alias("b"), "key", "class", "own")

    def compare(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        found = links([shingle_set(zlib.decompress(z.as_py()).decode()) for z in table.column("own")], table.column("class").to_numpy())
        src, dst = (np.array([keys[p[side]] for p in found], np.int64) for side in (0, 1))
        return pa.table({"src": src, "dst": dst})

    return tiled.groupBy("band", "a", "b").applyInArrow(compare, "src long, dst long").distinct()


def near_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """``key, first_id, component, component_id`` for each distinct text of ``docs``.

    ``first_id`` is the smallest doc_id that a text has, null if all its rows are
    without one. ``component`` is the smallest key, ``component_id`` the smallest doc_id among the texts that are linked by
    steps of similarity ``SIMILARITY`` or more. Null and empty texts are one
    text; texts of any length are compared whole. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([text_key(t.as_py()) for t in batch.column(1)], pa.int64())
            fps, bands = np.zeros(batch.num_rows, np.uint64), []
            for i, t in enumerate(batch.column(1)):
                own = digests(t.as_py())
                fps[i] = simhash.majority(own)
                bands.append(band_keys(np.unique(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(fps.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "fp", "bands"])

    spark = docs.sparkSession
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    own = rows.select("doc_id", F.col(text).alias("t")).mapInArrow(run, "doc_id long, key long, fp long, bands array<long>")
    distinct = keep(own.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    members = keep(tree_groups(distinct), "members")
    near = keep(near_links(members, distinct, rows, text), "links")
    classes = connected_components(near).select(F.col("node").alias("key"), F.col("component").alias("class"))
    drop(spark, members)
    members = keep(band_groups(distinct, classes), "members")
    comps = connected_components(near.unionByName(near_links(members, distinct, rows, text))).select(F.col("node").alias("key"), "component")
    joined = distinct.select("key", "first_id").join(comps, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = keep(joined.join(least, "component").select("key", "first_id", "component", "component_id"), "component-of")
    for made in (distinct, members, near, classes):
        drop(spark, made)
    return found


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id; of rows that share it, one with the
    text that is in the component, and of those the one whose columns have the smallest hash.

    A component whose rows are all without doc_id keeps one of them in the same way. The columns
    are those of ``docs``; an empty table stays empty.
    """
    found = near_components(docs, text)
    order = F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "key")
    chosen_id, key, hashed, place = (free_name(docs, x) for x in ("near_id", "near_key", "near_hash", "near_place"))
    chosen = found.groupBy("component").agg(F.min(order).alias("m")).select(F.col("m.first_id").alias(chosen_id), F.col("m.key").alias(key))
    # Keys are compared after the join by id, so that only the texts of rows with a chosen id are cut into words.
    named = docs.join(chosen.where(F.col(chosen_id).isNotNull()), F.col("doc_id") == F.col(chosen_id)).where(key_of(F.col(text)) - F.col(key) == 0)
    unnamed = docs.where("doc_id IS NULL").withColumn(key, key_of(F.col(text))).join(chosen.where(F.col(chosen_id).isNull()).select(key), key)
    rows = named.select(*docs.columns, key).unionByName(unnamed.select(*docs.columns, key)).withColumn(hashed, F.xxhash64(*docs.columns))
    first = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(hashed, text))
    return rows.withColumn(place, first).where(F.col(place) == 1).select(*docs.columns)
