"""Pairs of nearly equal titles by the ratio of their matching blocks."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 512
_BINS = 64


def fuzzy_titles(rows: DataFrame, floor: float = 0.85, mixed_floor: float = 0.75, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs ``a, b, ratio, reason`` (a < b) of titles at or above ``floor``, or ``mixed_floor`` for a preprint and another.

    ``rows`` has ``id, title, preprint``. Equal titles are one class, named by its
    smallest id; pairs are between classes, so that copies are not multiplied.
    Null and empty titles take no part; a null ``preprint`` never makes a pair mixed.

    Lengths that differ by more than the lower floor allows cannot match, so each
    length band meets itself and its neighbours only, in tiles of two blocks.
    Inside a tile the shared letters bound the ratio from above before it is computed.
    """
    lowest = min(floor, mixed_floor)
    width = math.log((2 - lowest) / lowest)
    classes = (
        rows.where("title IS NOT NULL AND title <> '' AND id IS NOT NULL").groupBy("title")
        .agg(F.min("id").cast("long").alias("id"), F.coalesce(F.bool_or("preprint"), F.lit(False)).alias("pre"), F.coalesce(F.bool_or(~F.col("preprint")), F.lit(False)).alias("other"))
        .withColumn("band", F.floor(F.log(F.length("title").cast("double")) / F.lit(width)).cast("int"))
    )
    held = {r["band"]: -(-r["count"] // block_rows) for r in classes.groupBy("band").count().collect()}  # one row a band: logarithmic in the longest title
    schema = "a long, b long, ratio double, reason string"
    if not held:
        return rows.sparkSession.createDataFrame([], schema)
    start, at = {}, 0
    for band in sorted(held):
        start[band], at = at, at + held[band]
    last = {band: start[band] + held[band] - 1 for band in held}

    def by_band(values: dict[int, int]):
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("band")]

    blocked = classes.withColumn("block", by_band(start) + F.pmod(F.xxhash64("title"), by_band(held).cast("long")).cast("int"))
    other = F.explode(F.sequence(by_band({k: start.get(k - 1, start[k]) for k in held}), by_band({k: last.get(k + 1, last[k]) for k in held})))
    tiles = blocked.withColumn("near", other).withColumn("lo", F.least("block", "near")).withColumn("hi", F.greatest("block", "near"))

    def bags(titles: pd.Series) -> np.ndarray:
        out = np.zeros((len(titles), _BINS), dtype=np.int32)
        for i, t in enumerate(titles):
            np.add.at(out[i], [ord(c) % _BINS for c in t], 1)
        return out

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        left, right = pdf[pdf["block"] == lo].reset_index(drop=True), pdf[pdf["block"] == hi].reset_index(drop=True)
        out = []
        if len(left) and len(right):
            lbag, rbag = bags(left["title"]), bags(right["title"])
            lsize, rsize = lbag.sum(1), rbag.sum(1)
            for i in range(len(left)):
                bound = 2 * np.minimum(lbag[i], rbag).sum(1) / (lsize[i] + rsize)
                x = left.iloc[i]
                for j in np.nonzero(bound >= lowest)[0]:
                    y = right.iloc[j]
                    if x["id"] == y["id"] or (lo == hi and x["id"] > y["id"]):
                        continue
                    first, second = (x, y) if x["id"] < y["id"] else (y, x)
                    mixed = bool((x["pre"] and y["other"]) or (x["other"] and y["pre"]))
                    ratio = SequenceMatcher(None, first["title"], second["title"]).ratio()
                    if ratio >= floor or (mixed and ratio >= mixed_floor):
                        out.append((first["id"], second["id"], ratio, "title" if ratio >= floor else "preprint and other"))
        return pd.DataFrame(out, columns=["a", "b", "ratio", "reason"])

    return tiles.groupBy("lo", "hi").applyInPandas(match, schema)
