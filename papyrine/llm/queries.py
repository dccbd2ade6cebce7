"""The operators' queries over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyrine.llm import classifier, license, packing, pieces, pii, quality, simhash, topk, toxicity, warc


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two best segmentations of every text, and whether decoding the best gives the text back."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = pieces.round_trip(docs, model, n=2)
    return out.select(
        "doc_id",
        F.get("n_best", 0)["n_pieces"].alias("n_pieces"),
        F.get("n_best", 0)["score"].alias("best_score"),
        F.get("n_best", 0)["ids_crc32"].alias("ids_crc32"),
        F.get("n_best", 1)["score"].alias("second_score"),
        F.get("n_best", 1)["ids_crc32"].alias("second_ids_crc32"),
        "round_trip",
    )


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(64 * x).cast("double")))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", whole.alias("v"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, 20)


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under pseudonyms of the session's key, with the number of replacements of each kind."""
    made = _read(spark, sf_dir, "documents").select("doc_id", pii.pseudonymise(F.col("text"), pii.session_key(spark)).alias("p"))
    count = lambda kind: F.size(F.filter("p.kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return made.select("doc_id", F.col("p.text").alias("text"), *counts)


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_components(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, name = quality.judged(_read(spark, sf_dir, "documents"))
    return df.select("doc_id", *(f"{name}.{x}" for x in (*quality.BASE, "base_failed", "p_good", "kept")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_read(spark, sf_dir, "pages"))[2]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_best_fit_packing, op3_sentencepiece, op4_exact_top_k, op5_pii_pseudonyms, op6_simhash_components, op7_quality_rules, op8_quality_classifier, op9_toxicity, op10_warc_archives, pipeline)
}

TOP_K_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 20"""

WARC_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM m"""

SQL: dict[str, str] = {"op1_license_scan": license.scan_sql(), "op4_exact_top_k": TOP_K_SQL, "op10_warc_archives": WARC_SQL}
