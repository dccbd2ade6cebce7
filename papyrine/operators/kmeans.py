"""k-means with fixed first centres (G4): Lloyd rounds as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def kmeans(points: DataFrame, k: int, rounds: int = 5) -> DataFrame:
    """``id, cluster`` of points ``id, v``: the k smallest ids are the first centres, ties go to the lowest cluster.

    The centres, k vectors, are the only thing that reaches the driver; an
    empty cluster keeps its centre.
    """
    own = points.select("id", F.col("v").cast("array<double>").alias("v"))
    centres = [r["v"] for r in own.orderBy("id").limit(k).collect()]
    assigned = own
    for _ in range(rounds):
        distance = [F.aggregate(F.zip_with("v", F.lit(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres]
        nearest = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distance))))
        assigned = own.select("id", "v", nearest["i"].alias("cluster"))
        means = assigned.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x")).collect()
        new = [list(c) for c in centres]
        for r in means:
            new[r["cluster"]][r["pos"]] = r["x"]
        centres = new
    return assigned.select("id", F.col("cluster").cast("long").alias("cluster"))
