"""Claims against claims: temporal joins J2 and J3, scorer R3.

The tables have no claims of papers; every vector stands for one. Its paper,
year and kind are derived from its id and label: claims of ``ITEM_KIND`` are the
open items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from papyrine.operators import near
from papyrine.shared import keep

ITEM_KIND = 0


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("owner"), (2010 + F.col("vec_id") % 12).alias("yr"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("v"))


def items(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("grp") == ITEM_KIND)


def _addressed(rows: DataFrame, threshold: float) -> DataFrame:
    """``item, best, near_later``: items with their best later claim and the number of later papers on the topic."""
    own = items(rows)
    found = keep(near.near(own, rows, near.later, threshold, per_owner=True), "later-claims")
    papers = near.reaching(found).groupBy("i").agg(F.count_distinct("owner").alias("near_later"))
    return own.select(F.col("id").alias("item"), "yr").join(near.nearest(found).withColumnRenamed("i", "item"), "item", "left").join(papers.withColumnRenamed("i", "item"), "item", "left").fillna(0, ["near_later"])


def j2_later_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _addressed(claims(spark, sf_dir), 0.2).where("best IS NOT NULL")
    status = F.when(F.col("best") >= 0.35, "addressed").when(F.col("near_later") < 5, "sparse").otherwise("open")
    return found.select("item", F.round("best", 5).alias("best"), "near_later", status.alias("status"))


def j3_later_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims(spark, sf_dir)
    found = near.reaching(near.near(items(rows), rows, near.later, 0.15, per_owner=True)).groupBy(F.col("i").alias("item"), F.col("owner").alias("paper")).agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sim"), "paper")).cast("long")
    return found.withColumn("rn", rank).where("rn <= 4").select("item", "paper", "rn", F.round("sim", 5).alias("sim"))


def r3_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exclusion rule for each item, in their order (R3a), and the score of what is shown."""
    rows = claims(spark, sf_dir)
    newest = F.broadcast(rows.agg(F.max("yr").alias("newest")))  # one row
    found = _addressed(rows, 0.15).crossJoin(newest).withColumn("age", F.col("newest") - F.col("yr")).withColumnRenamed("near_later", "near")
    verdict = F.when(F.col("best") >= 0.35, "addressed").when(F.col("near") < 5, "sparse").when(F.col("age") < 2, "young").otherwise("shown")
    score = 0.6 * F.col("near") / (F.col("near") + 8.0) + 0.4 * F.least(F.lit(1.0), F.col("age") / 6.0)
    return found.select("item", "near", "age", verdict.alias("verdict"), F.round(score, 6).alias("score"))


_C = "c AS (SELECT vec_id, CAST(floor(vec_id / 5) AS BIGINT) AS paper, 2010 + vec_id % 12 AS yr, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_LATER = f"WITH {_C}, p AS (SELECT i.vec_id AS item, c.paper, list_dot_product(i.v, c.v) AS sim FROM c i JOIN c ON c.yr > i.yr AND c.paper <> i.paper WHERE i.label = {ITEM_KIND})"

QUERIES = {f.__name__: f for f in (j2_later_claims, j3_later_papers, r3_orphans)}
SQL = {
    "j2_later_claims": f"""{_LATER}
        SELECT item, round(max(sim), 5) AS best, count(DISTINCT CASE WHEN sim >= 0.2 THEN paper END) AS near_later,
          CASE WHEN max(sim) >= 0.35 THEN 'addressed' WHEN count(DISTINCT CASE WHEN sim >= 0.2 THEN paper END) < 5 THEN 'sparse' ELSE 'open' END AS status FROM p GROUP BY item""",
    "j3_later_papers": f"""{_LATER}, m AS (SELECT item, paper, max(sim) AS sim FROM p WHERE sim >= 0.15 GROUP BY item, paper)
        SELECT item, paper, rn, round(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sim DESC, paper) AS rn FROM m) x WHERE rn <= 4""",
    "r3_orphans": f"""{_LATER}, m AS (SELECT max(yr) AS newest FROM c), g AS (SELECT item, max(sim) AS best, count(DISTINCT CASE WHEN sim >= 0.15 THEN paper END) AS n FROM p GROUP BY item)
        SELECT i.vec_id AS item, coalesce(g.n, 0) AS near, newest - i.yr AS age, CASE WHEN best >= 0.35 THEN 'addressed' WHEN coalesce(g.n, 0) < 5 THEN 'sparse' WHEN newest - i.yr < 2 THEN 'young' ELSE 'shown' END AS verdict,
          round(0.6e0 * coalesce(g.n, 0) / (coalesce(g.n, 0) + 8e0) + 0.4e0 * least(1e0, (newest - i.yr) / 6e0), 6) AS score FROM c i LEFT JOIN g ON g.item = i.vec_id CROSS JOIN m WHERE i.label = {ITEM_KIND}""",
}
