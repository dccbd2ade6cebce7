"""The best words and pairs of adjacent words of each document, without a row for each document and term.

Tasks count in how many documents a term stands and hand on a row a term, not
one a document and term. The terms of most documents go to all tasks with their
weight; a document's other terms are looked for in a Bloom filter of those that count at
all, and only what is found there, and could be among the best, is joined to its exact frequency.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from papyrine.plans.dialect import Spark
from papyrine.shared import keep

_WORD = re.compile(rb"[a-z0-9]{3,}")
#: Documents that a word and a pair must stand in, and how many of each a document has at most.
LEAST, MOST = (2, 3), (45, 25)
#: Terms that all tasks know, terms that a task counts before it hands them on, rows of a batch.
KNOWN, COUNTED, ROWS = 1 << 18, 400_000, 100_000
#: Bits of a part of the Bloom filter, for how many terms at 16 bits each, and parts at most (32 MB; beyond it more is found by chance).
PART, PART_TERMS, PARTS = 1 << 20, 1 << 16, 256
#: Repeated ids of documents that are sent to all tasks rather than joined by shuffle.
REPEATED = 100_000
SEED = 42


def counts(texts: Sequence[bytes | None]) -> tuple[Counter, Counter]:
    """How often each word and each pair of adjacent words stands in the texts, which are in lower case."""
    words = [_WORD.findall(t) for t in texts if t]
    return Counter(w for own in words for w in own), Counter(a + b"__" + b for own in words for a, b in zip(own, own[1:]))


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, half away from zero of the binary product, as DuckDB rounds; for values of zero or more."""
    scaled = x * 1e6
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 1e6


def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a term's hash in its part of the Bloom filter."""
    return (hashes >> np.uint64(24)) & np.uint64(PART - 1), (hashes >> np.uint64(44)) & np.uint64(PART - 1)


def _strings(terms: list[bytes]) -> pa.Array:
    return pa.array(terms, pa.binary()).cast(pa.string())


def _by_id(docs: DataFrame, text: str) -> DataFrame:
    """``doc_id, texts``: a row for each id, null included, with the lower-cased texts of all its rows."""
    own = docs.select("doc_id", F.lower(text).cast("binary").alias("t"))
    again = keep(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    n = again.count()
    if not n:
        return own.select("doc_id", F.array("t").alias("texts"))
    ids = F.broadcast(again) if n <= REPEATED else again
    same = own["doc_id"].eqNullSafe(ids["again"])
    single = own.join(ids, same, "left_anti").select("doc_id", F.array("t").alias("texts"))
    return single.unionByName(own.join(ids, same).groupBy("doc_id").agg(F.collect_list("t").alias("texts")))


def _frequencies(by_id: DataFrame) -> DataFrame:
    """``term, bigram, df`` of the terms that stand in enough documents; a pair has two signs ``_``, which no word has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def handed() -> pa.RecordBatch:
            terms = sorted(found)
            return pa.RecordBatch.from_arrays([_strings(terms), pa.array([found[t] for t in terms], pa.int64())], names=["term", "df"])

        for batch in batches:
            for texts in batch.column(0):
                for own in counts(texts.as_py()):
                    found.update(own.keys())
                if len(found) >= COUNTED:
                    yield handed()
                    found.clear()
        yield handed()

    summed = by_id.select("texts").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    rows = summed.select("term", F.instr("term", "__").cast("boolean").cast("int").alias("bigram"), "df")
    return keep(rows.where(f"df >= CASE WHEN bigram = 1 THEN {LEAST[1]} ELSE {LEAST[0]} END"), "document-frequencies")


def _filter_parts(rare: DataFrame, n: int) -> list[np.ndarray]:
    """A Bloom filter of the terms, by part; each part is set in one task."""
    parts = 1
    while parts < PARTS and parts * PART_TERMS < n:
        parts *= 2

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(PART, bool)
        for at in places(table.column("h").to_numpy().view(np.uint64)):
            bits[at] = True
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(bits).tobytes()]})

    hashed = rare.select(F.xxhash64("term").alias("h")).withColumn("part", F.col("h").bitwiseAND(parts - 1))
    found = {r["part"]: r["bits"] for r in hashed.groupBy("part").applyInArrow(run, "part long, bits binary").collect()}
    return [np.frombuffer(found.get(i, bytes(PART // 8)), np.uint8) for i in range(parts)]


def top_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, term, bigram, weight, place``: the 45 best words and 25 best pairs of each id, by weight, then term.

    A term's weight is ``(0.5 + 0.5 * c / m) * ln((n + 1) / (df + 0.5))``: c its number in the document,
    m the highest of the document's kind of terms, n all rows. Rows of one id, null
    included, are one document; null texts have no terms. An empty table gives an empty table.
    """
    by_id = _by_id(docs, text)
    terms = _frequencies(by_id)
    n = float(docs.count())
    weighted = terms.withColumn("idf", F.expr(f"ln(({n!r}D + 1) / (df + 0.5e0))"))
    # The terms in so many documents or more that there are KNOWN of them at most; the others are rare.
    known, cut, rare = 0, None, 0
    for r in sorted(terms.groupBy("df").agg(F.count("*").alias("n")).collect(), reverse=True):
        if rare or known + r["n"] > KNOWN:
            rare += r["n"]
        else:
            known, cut = known + r["n"], r["df"]
    frequent = weighted.where("false" if cut is None else f"df >= {cut}").select("term", "idf").toArrow()
    shipped = b"\n".join(frequent.column("term").cast(pa.binary()).to_pylist()), frequent.column("idf").to_numpy().tobytes()
    parts = _filter_parts(terms if cut is None else terms.where(f"df < {cut}"), rare) if rare else []
    # What a rare term's weight is at most for each share, with room for another logarithm's last digit.
    highest = [float(np.log((n + 1) / (x + 0.5))) * (1 + 1e-9) + 1e-9 for x in LEAST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        idf_of = dict(zip(shipped[0].split(b"\n"), np.frombuffer(shipped[1]).tolist()))
        bits = np.stack(parts) if parts else None
        at, names, kinds, weights, shares, ranks = columns = [], [], [], [], [], []

        def made(ids: pa.Array) -> pa.RecordBatch:
            arrays = [ids.take(pa.array(at, pa.int64())), _strings(names), pa.array(kinds, pa.int32()), pa.array(weights, pa.float64()), pa.array(shares, pa.float64()), pa.array(ranks, pa.int64())]
            for x in columns:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "term", "bigram", "weight", "share", "place"])

        def there(some: list[bytes]) -> np.ndarray:
            hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in some], np.uint64)
            part = (hashes & np.uint64(len(bits) - 1)).astype(np.int64)
            found = np.ones(len(some), bool)
            for place in places(hashes):
                found &= (bits[part, (place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1
            return found

        def best(i: int, kind: int, own: Counter) -> None:
            words, often = list(own), np.fromiter(own.values(), np.float64, len(own))
            share = 0.5 + 0.5 * often / often.max()
            idf = np.fromiter(map(idf_of.get, words, repeat(-1.0)), np.float64, len(own))
            weight = rounded(share * np.maximum(idf, 0))
            chosen, least = np.flatnonzero(idf >= 0), -1.0
            if len(chosen) >= MOST[kind]:
                least = np.partition(weight[chosen], -MOST[kind])[-MOST[kind]]
                chosen = chosen[weight[chosen] >= least]
            ranked = sorted(zip((-weight[chosen]).tolist(), [words[j] for j in chosen]))[: MOST[kind]]
            more: list[int] = []
            if bits is not None:
                left = np.flatnonzero((idf < 0) & (rounded(share * highest[kind]) >= least))
                more = left[there([words[j] for j in left])].tolist() if len(left) else []
            at.extend(repeat(i, len(ranked) + len(more)))
            names.extend(t for _, t in ranked)
            names.extend(words[j] for j in more)
            kinds.extend(repeat(kind, len(ranked) + len(more)))
            weights.extend(-w for w, _ in ranked)
            weights.extend(repeat(None, len(more)))
            shares.extend(repeat(None, len(ranked)))
            shares.extend(share[more].tolist())
            ranks.extend(repeat(None, len(ranked) + len(more)) if more else range(1, len(ranked) + 1))

        for batch in batches:
            for i, texts in enumerate(batch.column(1)):
                for kind, own in enumerate(counts(texts.as_py())):
                    if own:
                        best(i, kind, own)
                if len(at) >= ROWS:
                    yield made(batch.column(0))
            yield made(batch.column(0))

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    found = by_id.select("doc_id", "texts").mapInArrow(run, f"doc_id {kind_of_id}, term string, bigram int, weight double, share double, place long")
    shown = ["doc_id", "term", "bigram", "weight", "place"]
    if not rare:
        return found.select(*shown)
    found = keep(found, "best-terms")
    joined = found.where("share IS NOT NULL").join(weighted.select("term", "idf"), "term").select("doc_id", "term", "bigram", F.expr(Spark.round("share * idf", 6)).alias("weight"))
    open_ones = found.where("share IS NULL AND place IS NULL").select("doc_id", "term", "bigram", "weight").unionByName(joined)
    place = F.row_number().over(Window.partitionBy("doc_id", "bigram").orderBy(F.desc("weight"), "term")).cast("long")
    placed = open_ones.withColumn("place", place).where(f"place <= CASE WHEN bigram = 1 THEN {MOST[1]} ELSE {MOST[0]} END")
    return found.where("place IS NOT NULL").select(*shown).unionByName(placed.select(*shown))
