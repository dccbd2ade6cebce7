"""Batches of requests that are answered later (T4, T5), and searches by widening tiers.

The store is a folder of append-only tables. What a batch is follows from its
key, so that a driver that was killed finds what it has submitted, and doing a
step again adds nothing: a batch is submitted once, collected once and billed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException


class Batches:
    """Pending and collected batches under ``path``; rows of requests have ``batch, request, cost``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def pending(self) -> DataFrame:
        """``batch, requests``: what was submitted, each batch once."""
        return self._table("pending", "batch long, requests long").groupBy("batch").agg(F.max("requests").alias("requests"))

    def collected(self) -> DataFrame:
        """``batch, answers, billed``: each batch once, however often its result was fetched."""
        return self._table("collected", "batch long, answers long, positive long, billed double").groupBy("batch").agg(F.max("answers").alias("answers"), F.max("positive").alias("positive"), F.max("billed").alias("billed"))

    def submit(self, requests: DataFrame) -> None:
        """Submit the batches that are not pending yet."""
        own = requests.groupBy("batch").agg(F.count("*").alias("requests"))
        own.join(self.pending().select("batch"), "batch", "left_anti").write.mode("append").parquet(f"{self.path}/pending")

    def collect(self, answers: DataFrame) -> None:
        """Take in the results of pending batches that are there; those that were taken in before are not billed again."""
        own = answers.groupBy("batch").agg(F.count("*").alias("answers"), F.sum(F.col("answer").cast("long")).alias("positive"), F.sum("cost").alias("billed"))
        fresh = own.join(self.pending().select("batch"), "batch", "left_semi").join(self.collected().select("batch"), "batch", "left_anti")
        fresh.write.mode("append").parquet(f"{self.path}/collected")

    def state(self) -> DataFrame:
        """Every batch: its requests, its answers, what it cost."""
        done = self.collected().withColumn("billed", F.round("billed", 4))
        return self.pending().join(done, "batch", "left").select("batch", "requests", "answers", "positive", "billed")


def widen(tiers: list[DataFrame], need: int, calls: int) -> list[tuple[int, bool, int, int, str]]:
    """A funnel row ``tier, searched, found, total, state`` for each tier: searched in order until ``need`` are found or the calls are used up.

    A tier is one call, made only when it is its turn; the driver sees counts alone.
    """
    rows, total, state = [], 0, "searching"
    for i, tier in enumerate(tiers):
        state = "enough" if total >= need else "budget" if i >= calls else "searching"
        found = tier.count() if state == "searching" else 0
        total += found
        rows.append((i, state == "searching", found, total, state))
    return rows
