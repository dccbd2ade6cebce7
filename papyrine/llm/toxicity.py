"""Toxicity: subword-bag embeddings, averaged, under a linear softmax; all trained jointly in numpy.

A word is the bag of its n-grams of 3 to 6 characters, hashed into a table of
embeddings, so that an unseen misspelling shares most vectors with the word it
comes from. What has more than 64 characters without a space is cut at signs and
into overlapping pieces, which are its words. A window of words is the mean of its words. As one insult in a long
text is enough, a text counts by its most toxic windows: each epoch takes every
text's highest window so far as its example. After training, table and softmax
fold into one number for each n-gram bucket, and a text costs one lookup a word.
Its score is a logistic regression on its three highest windows, which do not
overlap, and on the mean of its words.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from papyrine.llm.text import Recent, free_name

#: Words of a window, words from one to the next, windows that a text counts by.
WINDOW, STEP, TOP = 6, 3, 3
BUCKETS, DIM, EPOCHS, BATCH, RATE, DECAY, POSITIVE_WEIGHT = 1 << 18, 8, 12, 64, 0.2, 1e-4, 3.0
#: Epochs that see whole texts as bags, and texts that a bucket must be in to be trained.
BAG_EPOCHS, MIN_TEXTS = 2, 4
LAST_BUCKET = BUCKETS - 1
GRAMS = (3, 4, 5, 6)
#: Words of more characters are cut at signs that join words, and what is still longer into pieces of PIECE characters that begin every PIECE_STEP.
LONGEST, PIECE, PIECE_STEP = 64, 16, 8
JOINTS = re.compile(r"[_\-/\\,;:|+=~<>()\[\]{}、。，．！？；：…·「」『』（）]+")
ENDS = ".,;:!?\"'()[]*#$%&|"
#: The training sample: so many labelled texts at most, and so many characters in all of them but the last.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 1 << 25
#: Words of a generation whose scores a worker remembers.
CACHE = 150_000
TOXIC_AT = 0.7


def text_words(text: str | None) -> list[str]:
    """The words of a text in order, between them all of its characters but spaces and signs at which long words are cut."""
    words = (text or "").split()
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out: list[str] = []
    for word in words:
        if len(word) <= LONGEST or len(word.strip(ENDS)) <= LONGEST:
            out.append(word)
            continue
        for part in list(filter(None, JOINTS.split(word))) or [word]:
            if len(part) <= LONGEST:
                out.append(part)
            else:
                out += [part[i : i + PIECE] for i in range(0, len(part) - PIECE + PIECE_STEP, PIECE_STEP)]
    return out


def gram_buckets(word: str) -> list[int]:
    """The buckets of a word's n-grams of characters, in lower case and with its ends marked; of shorter words themselves."""
    line = "<" + word.strip(ENDS).lower() + ">"
    marked, crc = line.encode("utf-8", "replace"), zlib.crc32
    size = len(line)
    if size == len(marked):
        return [crc(marked[i : i + n]) & LAST_BUCKET for n in GRAMS for i in range(max(1, size - n + 1))]
    at = [0, *accumulate(len(c.encode("utf-8", "replace")) for c in line)]
    return [crc(marked[at[i] : at[min(size, i + n)]]) & LAST_BUCKET for n in GRAMS for i in range(max(1, size - n + 1))]


def window_bounds(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words; the last one ends with the text."""
    return np.unique(np.r_[np.arange(0, max(1, n - WINDOW + 1), STEP), max(0, n - WINDOW)])


def top_windows(scores: np.ndarray) -> tuple[list[float], list[int]]:
    """The highest means of a window's word scores, and where those windows start: TOP windows at most, none of which overlap."""
    sums = np.r_[0.0, np.cumsum(scores)]
    starts = window_bounds(len(scores))
    ends = np.minimum(starts + WINDOW, len(scores))
    means = (sums[ends] - sums[starts]) / (ends - starts)
    found, places = [], []
    while len(found) < TOP:
        at = int(means.argmax())
        if means[at] == -np.inf:
            break
        found.append(float(means[at]))
        places.append(int(starts[at]))
        means[(starts < ends[at]) & (ends > starts[at])] = -np.inf
    return found, places


def _gather(ws: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The buckets of the words ``ws``, one word after the other."""
    own = sizes[ws]
    return flat[np.repeat(starts[ws] - (np.cumsum(own) - own), own) + np.arange(own.sum())]


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> dict:
    """Fit on texts with labels 0 and 1: a number for each bucket, and the weights from a text's :func:`summary` to its log odds.

    The first epochs see a text as the bag of its distinct words, later
    ones as its highest windows. Buckets that few texts have stay at zero, so that
    no single text is learned by heart. A fifth of the texts is only for the weights.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text_words(t)], np.int32) for t in texts]
    buckets, counts = array("i"), array("i")
    for w in vocabulary:
        own = gram_buckets(w)
        buckets.extend(own)
        counts.append(len(own))
    sizes, flat = np.array(counts, np.int64), np.frombuffer(buckets, np.int32) if buckets else np.zeros(0, np.int32)
    starts = np.cumsum(sizes) - sizes
    distinct = [np.unique(d) for d in docs]
    seen = np.zeros(BUCKETS, np.int64)
    for d in distinct:
        if len(d):
            seen[np.unique(_gather(d, starts, sizes, flat))] += 1
    usual = seen >= MIN_TEXTS
    y = np.array(labels, np.float64)
    table, soft, bias = np.zeros((BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    soft = (soft - soft.mean(axis=1, keepdims=True)).copy()
    squares = {"t": np.full(BUCKETS, 1e-6), "s": np.full(soft.shape, 1e-2), "b": np.full(2, 1e-2)}
    some = np.flatnonzero([len(d) > 0 for d in docs])
    held, fit = some[::5], np.array([i for k, i in enumerate(some) if k % 5], np.int64)

    def word_scores() -> np.ndarray:
        return np.add.reduceat((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)[flat], starts) / sizes if len(sizes) else np.zeros(0)

    for epoch in range(EPOCHS if len(fit) and 0 < y[fit].sum() < len(fit) else 0):
        scores = word_scores()
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            bags, target = [], []
            for i in batch:
                d = docs[i]
                if epoch < BAG_EPOCHS:
                    bags.append(distinct[i])
                    target.append(y[i])
                    continue
                for first in top_windows(scores[d])[1]:
                    bags.append(d[first : first + WINDOW])
                    target.append(y[i])
                if not y[i]:
                    first = rng.integers(0, max(1, len(d) - WINDOW + 1))
                    bags.append(d[first : first + WINDOW])
                    target.append(0.0)
            ws = np.concatenate(bags)
            words_in = np.array([len(b) for b in bags])
            rows, own = _gather(ws, starts, sizes, flat), sizes[ws]
            owner = np.repeat(np.repeat(np.arange(len(bags)), words_in), own)
            share = np.repeat(1.0 / (own * np.repeat(words_in, words_in)), own)
            t = np.array(target)
            edges = np.searchsorted(owner, np.arange(len(bags)))
            mean = np.add.reduceat(table[rows] * share[:, None], edges, axis=0)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            grad = p - np.stack([1 - t, t], 1)
            grad *= np.where(t > 0, POSITIVE_WEIGHT, 1.0)[:, None]
            g_soft, g_bias, g_mean = mean.T @ grad / len(t), grad.mean(axis=0), grad @ soft.T
            order = np.argsort(rows, kind="stable")
            ranked = rows[order]
            firsts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            used = ranked[firsts]
            g_table = np.add.reduceat(g_mean[owner[order]] * share[order][:, None], firsts, axis=0) + DECAY * table[used]
            g_table *= usual[used][:, None]
            squares["t"][used] += (g_table**2).mean(axis=1)
            squares["s"] += g_soft**2
            squares["b"] += g_bias**2
            table[used] -= RATE * g_table / np.sqrt(squares["t"][used])[:, None]
            soft -= RATE * g_soft / np.sqrt(squares["s"])
            bias -= RATE * g_bias / np.sqrt(squares["b"])
    scores = word_scores()
    weights = calibrate(np.array([summary(scores[docs[i]]) for i in held]).reshape(-1, TOP + 1), y[held])
    return {"bucket": (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), "weights": weights}


def summary(scores: np.ndarray) -> list[float]:
    """Of a text's word scores, one or more: its highest windows (the last one again if there are fewer) and the mean."""
    found = top_windows(scores)[0]
    return found + found[-1:] * (TOP - len(found)) + [float(scores.mean())]


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of labels on summaries, by Newton's method with a weak penalty: a weight for each column, then the constant."""
    if not len(x):
        return np.r_[np.full(x.shape[1], 1.0 / x.shape[1]), -2.0]
    middle, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.c_[(x - middle) / width, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], 0.05), 1e-6]
    w = np.r_[np.zeros(x.shape[1]), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + np.diag(penalty)
        w = w - np.linalg.solve(hess, design.T @ (p - y) + penalty * w)
    return np.r_[w[:-1] / width, w[-1] - (w[:-1] * middle / width).sum()]


class Scorer:
    """Scores texts with a trained model; remembers the scores of words."""

    def __init__(self, model: dict):
        self.weights, self.constant = model["weights"][:-1], float(model["weights"][-1])
        self.lowest = float(model["bucket"].min())
        value_of = model["bucket"].tolist().__getitem__

        def of_word(word: str) -> float:
            at = gram_buckets(word)
            return sum(map(value_of, at)) / len(at)

        self.words = Recent(of_word, CACHE)

    def __call__(self, text: str | None) -> float:
        words = text_words(text)
        x = summary(np.fromiter(map(self.words.__getitem__, words), np.float64, len(words))) if words else [self.lowest] * (TOP + 1)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights @ x) + self.constant))))


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from: CRC-32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> dict:
    """Train on a sample of the labelled rows of ``docs`` that are not held out.

    The sample is bounded by ``SAMPLE_ROWS`` and ``SAMPLE_CHARS``: the ids of
    smallest hash among those that have both a label and a row in ``docs``, up
    to the text with which the sum of characters passes its bound. Labels other than 0 and 1, null ones, and those of ids
    without a row are not used; of repeated labels the highest counts, of rows
    that share an id the text that sorts first.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    here = docs.select("doc_id").distinct().join(known, "doc_id")
    picked = here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    own = docs.select("doc_id", F.col(text).alias("t")).join(F.broadcast(picked), "doc_id")  # SAMPLE_ROWS ids
    rows = own.groupBy("doc_id").agg(F.min("t").alias("t"), F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    before = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # SAMPLE_ROWS rows
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).where(F.col("before") <= SAMPLE_CHARS)
    found = rows.orderBy("h", "doc_id").select("t", "toxic").collect()
    return train([r["t"] for r in found], [r["toxic"] for r in found])


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with their own columns and ``toxic_score``, a double from 0 to 1, as the last column.

    If there is such a column, underscores go before the new one's name. Null
    texts count as empty and score as the least toxic word; texts of any
    length are scored whole; repeated rows come back as often; an empty table
    gives an empty table.
    """
    name, at = free_name(docs, "toxic_score"), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = pa.array([scorer(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null texts count as empty and score as the least toxic word; repeated rows
    come back as often; without usable labels all scores are low; an empty
    table gives an empty table.
    """
    own = docs.select("doc_id", F.col(text).alias("text"))
    scored = score(own, fit(docs, labels, text))
    value = F.col(scored.columns[-1])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), value.alias("score"), (value >= TOXIC_AT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of ``docs``.

    Null and empty texts stay; repeated rows stay or go together; without usable
    labels all rows stay; an empty table gives an empty table.
    """
    scored = score(docs, fit(docs, labels, text), text)
    return scored.where(F.col(scored.columns[-1]) < TOXIC_AT).drop(scored.columns[-1])
