"""Section-aware cutting of full texts to a token budget."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Characters of an estimated token, and the words that open a section.
TOKEN_CHARS = 4
HEADINGS = "abstract|introduction|related work|background|method|methodology|approach|experiment|evaluation|result|discussion|limitation|conclusion|future work|references|appendix"

_SECTION = re.compile(rf"\n(?=(?:\d+\s+|\d+\.\s+)?(?:{HEADINGS})\b)", re.IGNORECASE)


def tokens(text: str) -> int:
    return max(1, len(text) // TOKEN_CHARS)


def _pack(units: Iterable[str], glue: str, budget: int, toll: int = 0) -> Iterator[str]:
    """Neighbours joined by ``glue`` as long as their estimates, plus ``toll`` a join, stay inside the budget."""
    held = ""
    for unit in units:
        if held and tokens(held) + tokens(unit) + toll > budget:
            yield held
            held = unit
        else:
            held = held + glue + unit if held else unit
    if held:
        yield held


def _fitted(text: str, budget: int, levels: tuple = ((_SECTION.split, "\n", 0), (lambda x: x.split("\n\n"), "\n\n", 0), (lambda x: x.split(" "), " ", 1))) -> list[str]:
    """A text that fits, else its parts on the first level, each fitted on the levels below, packed again."""
    if not levels or tokens(text) <= budget:
        return [text]
    (cut, glue, toll), *below = levels
    return list(_pack((piece for part in cut(text) for piece in _fitted(part, budget, tuple(below))), glue, budget, toll))


def section_chunks(docs: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """``key, chunk, text, tokens``: sections packed to the budget, cut at paragraphs, then at words, where one is too long.

    A word above the budget stays whole. A null text gives no chunk, a text that
    fits gives itself, white space in a longer one's chunks is trimmed at both ends.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, whole in zip(pdf["k"], pdf["t"]):
                if tokens(whole) <= budget:
                    out.append((k, 0, whole, tokens(whole)))
                    continue
                made = [x for x in _fitted(whole, budget) if x.strip()]
                out += [(k, i, x.strip(), tokens(x)) for i, x in enumerate(made)]
            yield pd.DataFrame(out, columns=["k", "chunk", "text", "tokens"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(cut, "k long, chunk long, text string, tokens long").withColumnRenamed("k", key)
