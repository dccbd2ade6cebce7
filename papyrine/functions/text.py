"""Text keys: accents folded to ASCII, titles, redaction, stems and terms (F1, F2, F7, F8, F16, F20, F33, F37), as expressions inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has one ASCII character, those characters, and the decompositions with more."""
    single, plain, several = [], [], {}
    for code in (*range(0x80, 0x2000), *range(0x2000, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        char = chr(code)
        ascii_ = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(ascii_) == 1:
            single.append(char)
            plain.append(ascii_)
        elif ascii_ and 0xFB00 <= code <= 0xFB06:
            several[char] = ascii_
    return "".join(single), "".join(plain), several


FOLDED, PLAIN, LIGATURES = _folds()


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition with everything but ASCII dropped; Spark has no function for it, so a table made from Unicode's data stands for it."""
    text = F.translate(text, FOLDED, PLAIN)
    for char, plain in LIGATURES.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def plain_key(text: Column) -> Column:
    """lower case, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def title_key(title: Column) -> Column:
    """without tags and accents, then as :func:`plain_key`; null stays null."""
    return plain_key(ascii_fold(F.regexp_replace(title, "<[^>]*>", "")))


def stem(word: Column, suffixes: Sequence[tuple[str, int]]) -> Column:
    """without the first of the suffixes that it ends with, if it is longer than the number beside that one."""
    out = word
    for suffix, longer in reversed(suffixes):
        out = F.when(word.endswith(suffix) & (F.length(word) > longer), F.substr(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def terms(text: Column, suffixes: Sequence[tuple[str, int]], stop: Sequence[str], short: int = 3, kept: Sequence[str] = ()) -> Column:
    """F8: ``stem, raw`` of the words of a text in order: no stop words before or after stemming, no numbers, none
    shorter than ``short`` but those in ``kept``. Null texts have none."""
    drop = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    usable = F.filter(words, lambda w: ((F.length(w) >= short) | w.isin(*kept)) & ~w.rlike("^[0-9]+$") & ~F.array_contains(drop, w))
    pairs = F.transform(usable, lambda w: F.struct(stem(w, suffixes).alias("stem"), w.alias("raw")))
    return F.filter(pairs, lambda p: ~F.array_contains(drop, p["stem"]))


def title_terms(title: Column, stop: Sequence[str]) -> Column:
    """the different words of a title with more than two characters that are no stop words."""
    words = F.filter(F.split(title_key(F.coalesce(title, F.lit(""))), " "), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.array_sort(F.array_distinct(words))


def capped(text: Column, limit: int) -> Column:
    """a text of at most ``limit`` characters, cut at the last space inside it and marked by dots if it is longer."""
    head = F.substring(text, 1, limit)
    whole = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(F.length(whole) > 0, whole).otherwise(head), F.lit("...")))


def redacted(text: Column) -> Column:
    """addresses, keys and tokens of a text or log line by what they are."""
    text = F.regexp_replace(text, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "[e-mail]")
    text = F.regexp_replace(text, "(sk-|ghp_|AKIA)[A-Za-z0-9_-]{12,}", "[secret]")
    return F.regexp_replace(text, "(?i)((api[_-]?key|token|secret|password)[ ]?[=:][ ]?)[^ \\n,;]+", "$1[secret]")


def atoms(text: Column, verbs: Sequence[str]) -> Column:
    """F16: the parts of a compound statement, or the text alone.

    Two or more markers such as ``(1)`` cut it, if each part has three words;
    else its semicolons do, if every part has three words and one of the verbs.
    """
    trimmed = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "^[ ,;.]+|[ ,;.]+$", ""))), lambda x: x != "")
    n_words = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)))
    marker = r"\((?:[0-9]{1,2}|[ivx]{1,4}|[a-h])\)"
    numbered = trimmed(F.slice(F.split(text, marker, -1), 2, 1000))
    halves = trimmed(F.split(text, ";", -1))
    says = lambda x: F.arrays_overlap(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, verbs)))
    by_marker = (F.size(F.regexp_extract_all(text, F.lit(marker), F.lit(0))) >= 2) & F.forall(numbered, lambda x: n_words(x) >= 3)
    by_half = (F.size(halves) >= 2) & F.forall(halves, lambda x: (n_words(x) >= 3) & says(x))
    return F.when(by_marker, numbered).when(by_half, halves).otherwise(F.array(text))
