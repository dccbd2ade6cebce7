"""Pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Longer keys are not remembered.
LONGEST_KEY = 64


class Recent(dict):
    """What a function makes of strings, remembered for the last two generations of ``size`` strings."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


#: The white space that separates words, for Java's and RE2's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for expressions that use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")
