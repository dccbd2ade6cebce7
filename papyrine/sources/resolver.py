"""Where records come from (S1, S5): a folder of seed files or the live source, never both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def seed(spark: SparkSession, path: str, schema: str, column: str, query: str = "", limit: int | None = None, order: str = "id") -> DataFrame:
    """The records of a folder of JSON files whose ``column`` has the query, whatever the case; the first ``limit`` in order. Broken records are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")
    if query:
        rows = rows.where(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(query.lower())))
    rows = rows.orderBy(order)
    return rows if limit is None else rows.limit(limit)


def resolve(setting: str, seeds: Callable[[], DataFrame], live: Callable[[], DataFrame], live_available: bool) -> tuple[str, DataFrame]:
    """The source that a setting names, 'seed', 'live' or 'auto' (live if it is available), and its rows; the other is not read."""
    if setting not in ("seed", "live", "auto"):
        raise ValueError(f"no such source: {setting}")
    if setting == "live" and not live_available:
        raise ValueError("the live source is not available")
    kind = "live" if setting == "live" or (setting == "auto" and live_available) else "seed"
    return kind, live() if kind == "live" else seeds()
