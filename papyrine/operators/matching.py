"""Greedy one-to-one matching by popularity inside a caliper."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def popularity_matches(items: DataFrame, group: str, caliper: float) -> DataFrame:
    """``group, positive, control, gap``: each positive's nearest free control by log1p of its count.

    ``items`` has ``group, id, positive, count``. Positives choose in the order of
    their ids, ties go to the smaller control, a control serves once. The choice
    is sequential inside a group, which must fit in a task; rows with a null do not take part.
    """
    schema = f"{group} string, positive long, control long, gap double"

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        mine, free = pdf[pdf["positive"]], pdf[~pdf["positive"]]
        level, ids, out = np.log1p(free["count"].to_numpy(float)), free["id"].to_numpy(), []
        for i, x in zip(mine["id"], np.log1p(mine["count"].to_numpy(float))):
            gap = np.abs(level - x)
            j = int(gap.argmin()) if len(gap) else -1
            if j >= 0 and gap[j] <= caliper:
                out.append((pdf[group].iloc[0], i, ids[j], gap[j]))
                level[j] = np.inf
        return pd.DataFrame(out, columns=[group, "positive", "control", "gap"])

    rows = items.select(F.col(group).cast("string"), F.col("id").cast("long"), F.col("positive").cast("boolean"), F.col("count").cast("double"))
    return rows.dropna().groupBy(group).applyInPandas(match, schema)
