"""Quality classifier from weak labels: overlapping labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Heuristic labellers vote on every text. The counts of vote patterns over all
texts give the labellers' accuracies; their posterior labels train a linear
model over hashed features (words, word shapes, statistics in steps), which
then scores every text. The scorer is fitted on a bounded sample; the
accuracies are estimated from all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from papyrine.llm import quality
from papyrine.llm.text import Recent

BUCKETS, EPOCHS, RATE, DECAY = 1 << 15, 60, 0.5, 1e-4
#: The scorer's sample: so many different texts at most, and so many characters in all of them but the last.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 1 << 25
#: Words of a generation whose features a worker remembers.
CACHE = 150_000
KEEP_AT = 0.5
LABELLERS = ("plain", "symbols", "separators", "shouting", "exclaims", "few_words", "same_lines", "few_distinct", "same_triples")

_UPPER, _SHAPE = re.compile("[A-Z]+"), re.compile(r"[^\W\d_]+|\d+")


def statistics(text: str | None) -> dict[str, float]:
    """Shares of a text that the labellers and the scorer look at; an empty text has no words and zero shares."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    return {
        "words": len(words),
        "symbols": sum(map(text.count, "#*$%&")) / n,
        "separators": sum(map(text.count, "|<>")) / n,
        "upper": sum(map(len, _UPPER.findall(text))) / max(1, len(text)),
        "exclaims": text.count("!") / n,
        "same_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "distinct": len(set(words)) / n,
        "same_triples": (len(triples) - len(set(triples))) / max(1, len(triples)),
    }


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """The labellers' votes: 1 good, -1 bad, 0 none."""
    plain = s["words"] >= 50 and s["symbols"] < 0.05 and s["separators"] < 0.05 and s["upper"] < 0.15 and s["exclaims"] < 0.03 and s["same_triples"] < 0.2 and s["same_lines"] < 0.2
    bad = (s["symbols"] > 0.3, s["separators"] > 0.3, s["upper"] > 0.4, s["exclaims"] > 0.1, s["words"] < 50, s["same_lines"] > 0.3, s["words"] >= 50 and s["distinct"] < 0.08, s["same_triples"] > 0.3)
    return (int(plain), *(-int(x) for x in bad))


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def word_buckets(word: str) -> tuple[int, int]:
    """The buckets of a word and of its shape."""
    shape = _SHAPE.sub(lambda m: "9" if m[0][0].isdigit() else "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return _bucket("w:" + word.lower()), _bucket("s:" + shape)


def text_buckets(s: dict[str, float]) -> list[int]:
    """The buckets of a text's statistics, in steps."""
    steps = [f"{k}:{min(10, int(20 * s[k]))}" for k in ("symbols", "separators", "upper", "exclaims", "same_lines", "same_triples")]
    return [_bucket(x) for x in [*steps, f"distinct:{int(20 * s['distinct'])}", f"words:{int(2 * math.log2(1 + s['words']))}"]]


def train(texts: list[str | None], targets: list[float], seed: int = 3) -> np.ndarray:
    """Weights of the buckets, the last one the constant, by logistic regression on soft labels."""
    rows, cols, values = [], [], []
    for i, t in enumerate(texts):
        words = (t or "").split()
        own = np.array([b for w in words for b in word_buckets(w)], np.int64)
        used, counts = np.unique(own, return_counts=True)
        fixed = np.unique(text_buckets(statistics(t)))
        rows.append(np.full(len(used) + len(fixed) + 1, i))
        cols.append(np.concatenate([used, fixed, [BUCKETS]]))
        values.append(np.concatenate([counts / max(1, len(words)), np.ones(len(fixed) + 1)]))
    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    if not texts:
        return weights
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    y = np.clip(np.array(targets), 0.02, 0.98)
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights[cols] * values, len(texts)), -30, 30)))
        grad = np.bincount(cols, (p - y)[rows] * values, BUCKETS + 1) / len(texts) + DECAY * weights
        squares += grad**2
        weights -= RATE * grad / np.sqrt(squares)
    return weights


class Scorer:
    """Scores texts with trained weights."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.words = weights, Recent(lambda word: float(weights[list(word_buckets(word))].sum()), CACHE)

    def __call__(self, text: str | None, s: dict[str, float]) -> float:
        words = (text or "").split()
        x = float(self.weights[-1]) + float(self.weights[np.unique(text_buckets(s))].sum())
        if words:
            x += sum(map(self.words.__getitem__, words)) / len(words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def sample(own: DataFrame, total: int) -> list[str]:
    """The texts that the scorer learns from: of the ``total`` rows ``doc_id, t`` those of smallest hash of both, each once.

    They are bounded by ``SAMPLE_ROWS`` and ``SAMPLE_CHARS`` and come in the order of the hash, so that
    the same rows give the same sample however they are dealt out. First only
    hashes are looked at, and of those only the smallest, more of them if too
    many are the same.
    """
    hashed = own.withColumn("h", F.xxhash64("doc_id", "t"))
    share = min(1.0, 8 * SAMPLE_ROWS / max(1, total))
    while True:
        few = hashed.where(F.col("h") <= int(share * 2**64) - 2**63 - 1) if share < 1 else hashed
        found = [r["h"] for r in few.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).collect()]
        if len(found) == SAMPLE_ROWS or share >= 1:
            break
        share = min(1.0, 8 * share)
    if not found:
        return []
    whole = hashed.where(F.col("h") <= found[-1]).groupBy("h").agg(F.min("t").alias("t"))  # SAMPLE_ROWS rows
    before = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    rows = whole.withColumn("before", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).where(F.col("before") <= SAMPLE_CHARS)
    return [r["t"] for r in rows.orderBy("h").select("t").collect()]


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, votes, p_weak, score, kept`` for each row of ``docs``.

    ``votes`` has a sign for each labeller, ``p_weak`` is their posterior
    probability of a good text, ``score`` the scorer's, and ``kept`` says
    whether that reaches 0.5. Null texts count as empty; texts of any length are read whole; repeated rows count and
    come back as often; other columns of ``docs`` play no part; an empty table gives an empty table.
    """
    own = docs.select("doc_id", F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            for t in batch.column(0):
                v = votes(statistics(t.as_py()))
                seen[v] = seen.get(v, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    counted = own.select("t").mapInArrow(count, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # a row for each pattern
    model = quality.estimate([(tuple(r["votes"]), r["n"]) for r in counted], len(LABELLERS))
    texts = sample(own, sum(r["n"] for r in counted))
    weights = train(texts, [quality.posterior(votes(statistics(t)), model["share"], model["prob"]) for t in texts])
    start, terms = quality.log_odds(model["share"], model["prob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in batches:
            signs, weak, scores = [], [], []
            for t in batch.column(1):
                t = t.as_py()
                s = statistics(t)
                v = votes(s)
                x = start + sum(terms[r][vote + 1] for r, vote in enumerate(v))
                signs.append("".join("-0+"[vote + 1] for vote in v))
                weak.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                scores.append(scorer(t, s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.string()), pa.array(weak, pa.float64()), pa.array(scores, pa.float64()), pa.array([x >= KEEP_AT for x in scores], pa.bool_())], names=["doc_id", "votes", "p_weak", "score", "kept"])

    return own.mapInArrow(run, "doc_id long, votes string, p_weak double, score double, kept boolean")
