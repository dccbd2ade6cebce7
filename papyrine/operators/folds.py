"""Operators that are sequential by definition, as ordered folds over one group each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


#: Items that a fold looks ahead at once.
_STEP = 512


def greedy_chunks(items: DataFrame, key: str, size: str, limit: float, order: str) -> DataFrame:
    """``items`` with ``chunk`` (from 0): in order, a chunk closes when the next item would exceed ``limit``.

    An item above the limit is a chunk of its own. Groups are folded apart; one
    group's sizes and keys must fit in a task.
    """
    schema = f"{key} long, {order} long, {size} double, chunk long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sizes, chunk = pdf[size].to_numpy(float), np.zeros(len(pdf), np.int64)
        at, n, used = 0, 0, 0.0
        while at < len(sizes):  # sums are made in the items' order, some items at once
            sums = np.cumsum(np.r_[used, sizes[at : at + _STEP]])
            over = np.flatnonzero((sums[1:] > limit) & (sums[:-1] != 0))
            end = int(over[0]) if len(over) else len(sums) - 1
            chunk[at : at + end] = n
            at, used, n = at + end, 0.0 if len(over) else sums[-1], n + bool(len(over))
        return pdf.assign(chunk=chunk)

    return items.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(size).cast("double")).groupBy(key).applyInPandas(fold, schema)


def admit(calls: DataFrame, key: str, cost: str, cap: float, order: str) -> DataFrame:
    """``admitted`` for each call in order: a call that would exceed the cap is refused and adds nothing."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        costs, admitted = pdf[cost].to_numpy(float), np.zeros(len(pdf), bool)
        at, spent = 0, 0.0
        while at < len(costs):  # up to the next call that goes beyond the cap
            sums = np.cumsum(np.r_[spent, costs[at : at + _STEP]])
            over = np.flatnonzero(sums[1:] > cap)
            end = int(over[0]) if len(over) else len(sums) - 1
            admitted[at : at + end] = True
            at, spent = at + end + bool(len(over)), sums[end]
        return pdf.assign(admitted=admitted)

    return calls.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(cost).cast("double")).groupBy(key).applyInPandas(fold, f"{key} long, {order} long, {cost} double, admitted boolean")


def round_robin(items: DataFrame, target: int, budget: float) -> DataFrame:
    """``run, library, item, place`` of what a run takes from libraries by turns: every library's cheapest first, then their next.

    An item that the rest of the budget does not allow is passed over and the run
    goes on until it has ``target`` items. Which items are taken depends on all
    before, so that a run is one task; items beyond the whole budget never reach it.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, taken = budget, []
        for row in pdf.sort_values(["turn", "library"]).itertuples(index=False):
            if len(taken) == target:
                break
            if row.cost <= left:
                left -= row.cost
                taken.append((row.run, row.library, row.item, len(taken) + 1))
        return pd.DataFrame(taken, columns=["run", "library", "item", "place"])

    turn = F.row_number().over(Window.partitionBy("run", "library").orderBy("cost", "item"))
    able = items.where(F.col("cost") <= budget).select("run", "library", F.col("item").cast("long").alias("item"), F.col("cost").cast("double").alias("cost"), turn.alias("turn"))
    return able.groupBy("run").applyInPandas(fold, "run string, library string, item long, place long")


def first_seen(rows: DataFrame, group: str, order: str, keys: list[str]) -> DataFrame:
    """The rows that share no key with an earlier *kept* row of their group; rejected rows register no keys."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        kept = []
        for row in pdf.sort_values(order).itertuples(index=False):
            own = {(k, getattr(row, k)) for k in keys if getattr(row, k) is not None}
            if not own & seen:
                seen |= own
                kept.append(row)
        return pd.DataFrame(kept, columns=pdf.columns)

    return rows.groupBy(group).applyInPandas(fold, rows.schema)


def louvain(edges: DataFrame, graph: str, passes: int = 20) -> DataFrame:
    """``graph, node, community`` by local moving in node order, ties to the smallest community; one graph a task."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, float]] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            if a != b:
                near.setdefault(a, {})[b] = 1.0
                near.setdefault(b, {})[a] = 1.0
        degree = {v: len(x) for v, x in near.items()}
        twice = sum(degree.values()) or 1
        label = {v: v for v in near}
        total = dict(degree)
        for _ in range(passes):
            moved = False
            for v in sorted(near):
                own = label[v]
                total[own] -= degree[v]
                links: dict[int, float] = {own: 0.0}
                for u in near[v]:
                    links[label[u]] = links.get(label[u], 0.0) + 1
                best = min(links, key=lambda c: (-(links[c] - degree[v] * total[c] / twice), c != own, c))
                total[best] += degree[v]
                moved |= best != own
                label[v] = best
            if not moved:
                break
        g = pdf[graph].iloc[0]
        return pd.DataFrame([(g, v, c) for v, c in sorted(label.items())], columns=[graph, "node", "community"])

    return edges.groupBy(graph).applyInPandas(fold, f"{graph} long, node long, community long")
