"""Structured Streaming over an event log: windows with a watermark, idempotent logs, a rate limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.shared import new_path


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of a Parquet table, a folder or a single file, its event time as a timestamp."""
    schema = spark.read.parquet(folder).schema
    path = folder[:-1] + f"[{folder[-1]}]"  # a pattern may name a single file, a plain path only a folder
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each type in each hour."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().select(F.col("w.start").alias("start"), "event_type", "count")


def once(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, tokens: float, seconds: int = 60) -> DataFrame:
    """Whether each event of a user fits under ``tokens`` within the last seconds; refused events use none.

    What is used is always the sum of the live costs from the oldest on: a cost that is
    taken off a running sum leaves its rounding error, which decides where a sum meets ``tokens`` exactly.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, costs = (deque(map(float, x)) for x in state.get) if state.exists else (deque(), deque())
        used = reduce(add, costs, 0.0)  # sum() would compensate
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        out = []
        for us, event_id, cost in zip(rows["us"], rows["event_id"], rows["value"]):
            if times and us - times[0] >= seconds * 1e6:
                while times and us - times[0] >= seconds * 1e6:
                    times.popleft()
                    costs.popleft()
                used = reduce(add, costs, 0.0)
            ok = used + cost <= tokens
            if ok:
                times.append(float(us))
                costs.append(float(cost))
                used += float(cost)
            out.append((key[0], event_id, ok))
        state.update((list(times), list(costs)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "admitted"])

    own = events.select("user_id", "event_id", "value", F.unix_micros("ts").alias("us"))
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, admitted boolean", "times array<double>, costs array<double>", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> tuple[StreamingQuery, str]:
    """Run a stream over what is there and end; its checkpoint lies in the shared folder."""
    spark = stream.sparkSession
    path = new_path(spark, f"stream-{name}")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", path + "-log").outputMode(mode).trigger(availableNow=True).start(path)
    else:
        query = stream.writeStream.option("checkpointLocation", path + "-log").outputMode(mode).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return query, path
