"""Places and running totals over a whole table without one task for all of it.

The table is sorted by ranges and written with the number of each range; the
driver sees a row for each range, and a row's place is its place in its range
after the ranges before.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from papyrine.shared import keep


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    return keep(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "sorted")


def _before(df: DataFrame, sums: list) -> DataFrame:
    """The range's number with the sum over the ranges before it."""
    ranges, values = [r for r, _ in sums], [v or 0 for _, v in sums]
    rows = list(zip(ranges, [0, *accumulate(values)][: len(values)]))
    return df.sparkSession.createDataFrame([(r, float(v)) for r, v in rows], "_range int, _before double")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with every row's place, from 1, in a total order. An empty table stays empty."""
    rows = _sorted(df, order)
    counts = sorted((r["_range"], r["count"]) for r in rows.groupBy("_range").count().collect())  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    found = rows.withColumn("_place", inside).join(F.broadcast(_before(df, counts)), "_range")
    return found.withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_before")


def running(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with every row; nulls add nothing."""
    rows = _sorted(df, order)
    sums = sorted((r["_range"], r["s"]) for r in rows.groupBy("_range").agg(F.sum(value).alias("s")).collect())  # a row a range
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_sum", F.coalesce(inside, F.lit(0))).join(F.broadcast(_before(df, sums)), "_range")
    return found.withColumn(name, F.col("_sum") + F.col("_before")).drop("_range", "_sum", "_before")
