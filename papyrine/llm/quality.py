"""Quality rules as weak supervision: votes, expectation-maximisation, posterior probability.

Each rule votes "good" (1), "bad" (-1) or abstains (0) on a text. The counts of
vote patterns over all texts, at most 3 ** number of rules rows, are the
sufficient statistics from which expectation-maximisation estimates how often
each rule votes what on good and on bad texts. A text is kept if its posterior
probability of being good reaches the threshold. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from papyrine.llm.text import NOT_SPACE, SPACE, free_name, words
from papyrine.shared import keep

#: Texts with fewer words, or with a larger share of words in repeated windows, fail the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_AT = 0.5
#: A start for the estimates: the share of good texts, and for either kind the probabilities of bad, no and good
#: votes; the rounds, and the texts that the start values count for.
PRIOR_GOOD, ON_GOOD, ON_BAD, ROUNDS, SMOOTH = 0.85, (0.02, 0.49, 0.49), (0.4, 0.5, 0.1), 50, 1.0

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words in windows found twice or more, from the windows' 64-bit hashes in order."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        hash_at = lambda i: F.get(pairs, i)["h"]
        again = F.filter(pairs, lambda x, i: ((i > 0) & (hash_at(i - 1) == x["h"])) | ((i < last) & (hash_at(i + 1) == x["h"])))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")), lambda a: a["sum"])

    sorted_pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(sorted_pairs), covered), 1))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column more: the base counts and what the rules need.

    Null texts count as empty. The column's name is returned as the last of
    the columns; it never clashes with one of ``docs``.
    """
    name = free_name(docs, "quality")
    t, w, h = (free_name(docs, f"quality_{x}") for x in "twh")
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, words(F.col(t)))
    n = F.size(w)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    df = df.withColumn(h, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.expr("array()").cast("array<bigint>")))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(NOT_SPACE))
    count = lambda pattern: F.length(F.regexp_replace(F.col(t), pattern, "")).cast("long")
    found = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("long").alias("n_distinct_lines"),
        _repeat_words(F.col(h), n).alias("n_repeat_words"),
        count(r"[^A-Z]+").alias("n_upper"),
        count(r"[^!]+").alias("n_exclaim"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
    )
    df = df.withColumn(name, found).drop(t, w, h)
    return df


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def votes(f: str) -> dict[str, Column]:
    """The rules' votes on a struct column of :func:`features`."""
    c = lambda x: F.col(f)[x]
    n, chars = c("n_words"), c("word_chars")
    plain = (20 * c("n_symbols") < n) & (10 * c("n_upper") < 2 * chars) & (50 * c("n_exclaim") < n) & (10 * c("n_repeat_words") < 2 * n)
    return {
        "plain": _vote(F.lit(False), plain),
        "symbols": _vote(10 * c("n_symbols") > 3 * n),
        "repeats": _vote(10 * c("n_repeat_words") > 3 * n),
        "dup_lines": _vote(10 * (c("n_lines") - c("n_distinct_lines")) > 3 * c("n_lines")),
        "upper": _vote(10 * c("n_upper") > 4 * chars),
        "exclaim": _vote(10 * c("n_exclaim") > n),
        "word_length": _vote((chars < 2 * n) | (chars > 14 * n)),
        "variety": _vote(100 * c("n_distinct_words") < 8 * n),
    }


def failed(f: str) -> Column:
    """The base rules: too few words, or too many of them in repeated windows."""
    n = F.col(f)["n_words"]
    return (n < MIN_WORDS) | (100 * F.col(f)["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> dict:
    """Share of good texts and, for each kind and rule, the probabilities of the votes -1, 0 and 1.

    ``patterns`` has each vote pattern with its count. Without any, the start
    values come back.
    """
    share = PRIOR_GOOD
    prob = {"good": [list(ON_GOOD)] * rules, "bad": [list(ON_BAD)] * rules}
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        weight = {k: [[SMOOTH * p for p in row] for row in prob[k]] for k in prob}
        sums = {"good": SMOOTH * share, "bad": SMOOTH * (1 - share)}
        for votes_, n in patterns:
            good = posterior(votes_, share, prob)
            for kind, p in (("good", good), ("bad", 1 - good)):
                sums[kind] += n * p
                for r, v in enumerate(votes_):
                    weight[kind][r][v + 1] += n * p
        share = sums["good"] / (total + SMOOTH)
        prob = {k: [[x / sum(row) for x in row] for row in weight[k]] for k in weight}
    return {"share": share, "prob": prob}


def log_odds(share: float, prob: dict) -> tuple[float, list[list[float]]]:
    """The posterior's log odds: a constant and a term for each rule and vote."""
    terms = [[math.log(max(g, 1e-9) / max(b, 1e-9)) for g, b in zip(*rows)] for rows in zip(prob["good"], prob["bad"])]
    return math.log(max(share, 1e-9) / max(1 - share, 1e-9)), terms


def posterior(pattern: tuple[int, ...], share: float, prob: dict) -> float:
    """Probability that a text with these votes is good."""
    start, terms = log_odds(share, prob)
    x = start + sum(terms[r][v + 1] for r, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def judged(docs: DataFrame, text: str = "text", keep_columns: bool = False) -> tuple[DataFrame, str]:
    """Each row of ``docs`` with a struct column (its name comes second) of base counts, ``p_good`` and ``kept``.

    Only doc_id stays beside it unless ``keep_columns``. The counts are written
    to the shared folder once, so that texts are read once for both passes.
    Nulls count as empty texts, which fail the base rules; repeated rows count
    and come back as often; an empty table gives an empty table.
    """
    df = features(docs if keep_columns else docs.select("doc_id", text), text)
    name = df.columns[-1]
    if not keep_columns:
        df = df.drop(text)
    vote_columns = votes(name)
    df = df.withColumn(name, F.col(name).withField("votes", F.array(*vote_columns.values())))
    kept = keep(df, "quality")
    counts = kept.where(~failed(name)).groupBy(F.col(name)["votes"].alias("votes")).count().collect()  # at most 3 ** rules rows
    model = estimate([(tuple(r["votes"]), r["count"]) for r in counts], len(vote_columns))
    start, terms = log_odds(model["share"], model["prob"])
    odds = F.lit(start)
    for r, term in enumerate(terms):
        odds = odds + F.element_at(F.array(*map(F.lit, term)), F.col(name)["votes"][r] + 2)
    p_good = F.lit(1.0) / (1 + F.exp(-odds))
    q = F.col(name)
    result = q.withField("n_dup_lines", q["n_lines"] - q["n_distinct_lines"]).withField("base_failed", failed(name)).withField("p_good", p_good).withField("kept", ~failed(name) & (p_good >= KEEP_AT))
    return kept.withColumn(name, result), name


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    df, name = judged(docs, text, keep_columns=True)
    return df.where(F.col(name)["kept"]).select(*docs.columns)
