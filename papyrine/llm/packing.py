"""Best-fit packing of tokenised documents with swap-based local search.

A packing depends on the lengths of the pieces only, and there are at most
``CAPACITY`` lengths, so the plan is made from the histogram of lengths: bins
with the same contents are one pattern with a multiplicity, whatever the number
of documents. Best-fit decreasing fills the bins; then the local search
exchanges one piece for one, two for one, or moves one, between two underfull
patterns wherever the sum of squared fills grows, which drains the emptiest
bins until they vanish. Pieces then find their place by their rank among the
pieces of their length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from papyrine.llm.text import Recent
from papyrine.shared import keep

CAPACITY = 2048
END_ID = 0
#: Distinct pieces of text of a generation whose ids a worker remembers.
CACHE = 250_000

#: The Unicode characters that the pattern's white space stands for.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Ids:
    """Token ids of texts as little-endian 32-bit numbers, by a tokenizer file of byte-level BPE.

    White space and the word after it never share a token with what stands
    before, so that such pieces are encoded once and remembered.
    """

    def __init__(self, data: bytes):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(data)
        self.whole = Tokenizer.from_str(data.decode("utf-8"))
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self.pieces = Recent(lambda piece: packed(encode(piece)), CACHE)
        self.split = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+").findall

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity if there are several."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, rank``: rank counts the pieces of a length in a part.

    The driver reads the tokenizer's file and ships its bytes.
    """
    data = Path(tokenizer).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, seen = Ids(data), Counter()
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text_.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(run, schema)


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing: patterns (sorted tuples of lengths) and how many bins have them."""
    bins: dict[int, Counter] = {}  # by space left
    spaces: list[int] = []
    done: Counter = Counter()

    def put(left: int, pattern: tuple, n: int) -> None:
        if left == 0:
            done[pattern] += n
            return
        if left not in bins:
            spaces.insert(bisect_left(spaces, left), left)
            bins[left] = Counter()
        bins[left][pattern] += n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                if n // each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - n % each * length, (length,) * (n % each), 1)
                break
            left = spaces[at]
            pattern, have = next(iter(bins[left].items()))
            each = min(left // length, n)
            m = min(have, n // each)
            bins[left][pattern] -= m
            if not bins[left][pattern]:
                del bins[left][pattern]
            if not bins[left]:
                del bins[left], spaces[at]
            put(left - each * length, pattern + (length,) * each, m)
            n -= m * each
    for patterns in bins.values():
        done.update(patterns)
    return Counter({tuple(sorted(p, reverse=True)): n for p, n in Counter(done).items() if n})


class _Underfull:
    """The patterns of a local search that are not full, with what they can take in and give away.

    A row for each pattern: ``takes_one[v]`` says that a piece of length v can
    go into it for nothing, for one piece or for two, ``takes_two[v]`` that two
    pieces of length v together can go in for one, each with a gain that its
    space allows; ``has_one`` and ``has_two`` are the lengths of its pieces and
    pairs of pieces. So only pairs of patterns that have an exchange are tried.
    """

    def __init__(self, capacity: int):
        self.capacity, self.row_of, self.free = capacity, {}, []
        self.rows: list[tuple | None] = []
        self.fill = np.full(0, -1, np.int64)
        self.takes_one, self.takes_two, self.has_one, self.has_two = (np.zeros((0, capacity + 1), bool) for _ in range(4))

    def add(self, p: tuple) -> int:
        if not self.free:
            more = max(64, len(self.rows))
            self.free = list(range(len(self.rows) + more - 1, len(self.rows) - 1, -1))
            self.rows += [None] * more
            self.fill = np.r_[self.fill, np.full(more, -1)]
            grown = (np.concatenate([x, np.zeros((more, self.capacity + 1), bool)]) for x in (self.takes_one, self.takes_two, self.has_one, self.has_two))
            self.takes_one, self.takes_two, self.has_one, self.has_two = grown
        i = self.free.pop()
        self.row_of[p], self.rows[i], self.fill[i] = i, p, sum(p)
        space, ones = self.capacity - sum(p), sorted(set(p))
        pairs = {x + y for k, x in enumerate(ones) for y in ones[k:] if x != y or p.count(x) > 1}
        for row in (self.takes_one[i], self.takes_two[i], self.has_one[i], self.has_two[i]):
            row[:] = False
        for x in (0, *ones, *pairs):
            self.takes_one[i, x + 1 : x + space + 1] = True
        for x in ones:
            self.takes_two[i, x + 1 : x + space + 1] = True
        self.has_one[i, ones] = True
        self.has_two[i, list(pairs)] = True
        return i

    def remove(self, p: tuple) -> None:
        i = self.row_of.pop(p)
        self.rows[i], self.fill[i] = None, -1
        for row in (self.takes_one[i], self.takes_two[i], self.has_one[i], self.has_two[i]):
            row[:] = False
        self.free.append(i)

    def receivers(self, b: int) -> np.ndarray:
        """Rows of the patterns, at least as full as that of row b, that have an exchange with it; the fullest first."""
        able = self.takes_one[:, self.has_one[b]].any(axis=1) | self.takes_two[:, self.has_two[b]].any(axis=1)
        found = np.flatnonzero(able & (self.fill >= self.fill[b]))
        return found[np.argsort(-self.fill[found], kind="stable")]


def local_search(patterns: Counter, capacity: int) -> Counter:
    """Exchange or move pieces between underfull bins until no change lets the sum of squared fills grow.

    Between a fuller bin a and an emptier bin b: a piece of b goes to a; or it
    goes there for a shorter piece of a; or for two pieces of a that are shorter
    together; or two pieces of b go for one shorter piece of a. Any of these
    shifts fill from b to a; the emptiest bins are drained first, into the
    fullest. Patterns stand for all their bins at once. The search ends of
    itself, as the sum of squares only grows.
    """
    first, patterns = patterns, Counter()
    under = _Underfull(capacity)

    def change(p: tuple, d: int) -> None:
        """``d`` bins more of a pattern."""
        before, now = patterns[p], patterns[p] + d
        patterns[p] = now
        if not now:
            del patterns[p]
        if p and sum(p) < capacity and bool(before) != bool(now):
            under.add(p) if now else under.remove(p)

    for p, n in first.items():
        if n:
            change(p, n)
    again = True
    while again:
        again = False
        for b in sorted(under.row_of, key=lambda p: (sum(p), p)):
            while patterns[b]:
                found = (under.rows[i] for i in under.receivers(under.row_of[b]).tolist())
                a = next((a for a in found if a != b or patterns[a] > 1), None)
                if a is None:
                    break
                fuller, emptier = _exchange(a, b, capacity - sum(a))
                n = patterns[a] // 2 if a == b else min(patterns[a], patterns[b])
                for p, d in ((a, -n), (b, -n), (fuller, n), (emptier, n)):
                    change(p, d)
                again = True
    del patterns[()]
    return patterns


def _exchange(a: tuple, b: tuple, space: int) -> tuple[tuple, tuple] | None:
    """The contents of a and b after the change that fills a most, or None if there is no change."""
    own_a, own_b = sorted(set(a)), sorted(set(b))
    out_of_a = [((), 0)] + [((x,), x) for x in own_a] + [((x, y), x + y) for i, x in enumerate(own_a) for y in own_a[i:] if x != y or a.count(x) > 1]
    best = None
    for one_b in own_b:
        for gone, size in out_of_a:
            gain = one_b - size
            if 0 < gain <= space and (best is None or gain > best[0]):
                best = (gain, gone, (one_b,))
    for i, x in enumerate(own_b):
        for y in own_b[i:]:
            if x == y and b.count(x) < 2:
                continue
            for one_a in own_a:
                gain = x + y - one_a
                if 0 < gain <= space and (best is None or gain > best[0]):
                    best = (gain, (one_a,), (x, y))
    if best is None:
        return None
    new_a, new_b = Counter(a), Counter(b)
    new_a.subtract(best[1])
    new_a.update(best[2])
    new_b.subtract(best[2])
    new_b.update(best[1])
    return tuple(sorted(new_a.elements(), reverse=True)), tuple(sorted(new_b.elements(), reverse=True))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of places: pieces of ``length`` with ranks from ``rank`` lie in sequences from ``sequence`` at ``offset``.

    Full-length pieces are patterns like any other. The runs are sorted by
    length and rank, and a run ends where the next one begins.
    """
    patterns = local_search(best_fit(histogram, capacity), capacity) if histogram else Counter()
    rows, used, sequence = [], Counter(), 0
    for pattern, n in sorted(patterns.items(), reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Null texts count as empty and give the end id alone; rows without doc_id
    and repeated rows are packed like any other; an empty table gives an empty
    table; other columns of ``docs`` play no part. Only the histogram of lengths, ``capacity`` rows, reaches the driver.
    """
    cut_up = keep(pieces(docs, tokenizer, text, capacity), "pieces")
    counts = keep(cut_up.groupBy("part", "length").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # A row for each part and length: not for a broadcast, as the parts grow with the documents.
    ranked = cut_up.join(bases.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks = places["length"], places["rank"]
        first = {int(x): i for i, x in reversed(list(enumerate(lengths)))}
        last = {int(x): i + 1 for i, x in enumerate(lengths)}
        for batch in batches:
            own, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            for length in np.unique(own).tolist():
                at, a, b = np.flatnonzero(own == length), first[length], last[length]
                run_ = a + np.searchsorted(ranks[a:b], rank[at], "right") - 1
                sequence[at] = places["sequence"][run_] + rank[at] - ranks[run_]
                offset[at] = places["offset"][run_]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
