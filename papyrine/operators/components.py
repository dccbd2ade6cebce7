"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papyrine.shared import drop, keep


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each end of an edge with the smallest node that it reaches: ``node, component``.

    ``edges`` is undirected; null ends and self-loops link nothing and are left
    out, repeated edges count once. An empty table gives an empty table. Each
    round takes the least label among the neighbours and then the label of the
    label, so that a chain of length n needs about log n rounds. Rounds are
    written to the shared folder; the driver sees only the number of changes.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    # Both directions come from one evaluation: edges that are made anew may be others that connect the same nodes.
    both = keep(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        far = near.join(labels.select(F.col("node").alias("label"), F.col("label").alias("jump")), "label", "left")
        step = keep(far.select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        changed = step.where("old <> label").limit(1).count()
        drop(spark, labels)
        labels = step.select("node", "label")
        if not changed:
            drop(spark, both)
            return labels.withColumnRenamed("label", "component")
