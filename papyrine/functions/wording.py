"""Wording of reports and phrase tests (F10, F15, F23, F34, F35), as expressions inside the JVM; words and sentences are parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

# Characters that LaTeX reads as commands and how they are written.
LATEX = {
    "\\": "\\textbackslash{}",
    "~": "\\textasciitilde{}",
    "^": "\\textasciicircum{}",
    "&": "\\&",
    "%": "\\%",
    "$": "\\$",
    "#": "\\#",
    "_": "\\_",
    "{": "\\{",
    "}": "\\}",
}
_LATEX_PARTS = r"[^\\~^&%$#_{}]+|[\\~^&%$#_{}]"


def latex(text: Column) -> Column:
    """Text that LaTeX prints as it stands; null stays null.

    The text is cut into command characters and what is between them; each part is looked up once.
    """
    written = F.create_map(*(F.lit(x) for pair in LATEX.items() for x in pair))
    parts = F.regexp_extract_all(text, F.lit(_LATEX_PARTS), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(written, p), p)), "")


def readable(slug: Column) -> Column:
    """A category's slug as words."""
    return F.translate(slug, "-_", "  ")


def expand(tokens: Column, words: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Tokens followed by the synonyms of each word, in the words' order; a word without any adds none."""
    if not synonyms:
        return tokens
    table = F.create_map(*(c for w, own in synonyms.items() for c in (F.lit(w), F.array(*map(F.lit, own)))))
    added = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    return F.concat(tokens, added)


def spans(tokens: Column, phrase: str) -> Column:
    """Start and end (past the last token) of each place where the phrase's words follow one another."""
    parts = phrase.lower().split()
    n = len(parts)
    if not n:
        return F.array().cast("array<struct<a:int,b:int>>")
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    here = lambda i: F.slice(tokens, i + 1, n) == F.array(*map(F.lit, parts))
    return F.transform(F.filter(places, here), lambda i: F.struct(i.alias("a"), (i + n).alias("b")))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside other functions' lambdas an expression is computed at each step."""
    return F.get(F.transform(F.array(value), body), 0)


def co_occur(tokens: Column, one: Sequence[str], other: Sequence[str], window: int) -> Column:
    """Whether a phrase of each list stand within ``window`` tokens; null and empty tokens say no."""
    places = lambda t, phrases: F.flatten(F.array(*(spans(t, p) for p in phrases)))
    near = lambda x, y: F.least(F.abs(x["a"] - y["b"]), F.abs(y["a"] - x["b"])) <= window
    found = _bound(tokens, lambda t: _bound(places(t, other), lambda b: F.exists(places(t, one), lambda x: F.exists(b, lambda y: near(x, y)))))
    return F.coalesce(found, F.lit(False))


def tokens(text: Column) -> Column:
    """Words of three characters or more, in lower case and without other signs than hyphens."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\- ]+", "")
    return F.filter(F.split(plain, " +"), lambda t: F.length(t) > 2)


def tone(words: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """The name of the first list that has one of the words; empty if none has."""
    found = F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, own))), F.lit(name)) for name, own in lists.items()))
    return F.coalesce(F.get(F.array_compact(found), 0), F.lit(""))


def in_both(a: Column, b: Column, pool: Sequence[str]) -> Column:
    """The first word of the pool that both sides have, null if there is none."""
    return F.get(F.array_intersect(F.array_intersect(F.array(*map(F.lit, pool)), a), b), 0)


def pair_title(a: Column, b: Column, pools: Sequence[Sequence[str]], tones: Mapping[str, Sequence[str]], endings: Mapping[tuple[str, str], str], otherwise: str, without: str) -> Column:
    """A title for two claims: the words of each pool that both name, and an ending by how the claims sound.

    ``endings`` is a table of cases: the tones of both claims and the ending for
    them; other tones have ``otherwise``. Claims that share no word of some pool have ``without``.
    """
    x, y = tokens(a), tokens(b)
    table = F.create_map(*(F.lit(t) for (one, other), ending in endings.items() for t in (f"{one}/{other}", ending)))
    subject = F.concat_ws(" / ", *(in_both(x, y, pool) for pool in pools))
    named = F.size(F.array_compact(F.array(*(in_both(x, y, pool) for pool in pools)))) == len(pools)
    ending = F.coalesce(F.try_element_at(table, F.concat_ws("/", tone(x, tones), tone(y, tones))), F.lit(otherwise))
    return F.when(named, F.concat_ws(": ", subject, ending)).otherwise(F.lit(without))
