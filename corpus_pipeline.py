"""The corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. ``run`` applies them to the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyrine.llm import packing, pii, quality, shingles, toxicity
from papyrine.llm.queries import tokenizer_path
from papyrine.shared import keep, scope, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weakly supervised quality rules do not reject.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty.
    """
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; the model learns from the labels of those that came this far.

    Null and empty texts stay; repeated rows stay or go together; without usable labels all stay; an empty table stays empty.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, see :func:`shingles.one_of_each`.

    Near are texts whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more; a group is what such pairs connect. Pairs come from the fingerprints' vantage-point trees, then from bands. Null and empty texts are one group; an empty table stays empty.
    """
    return shingles.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts under pseudonyms of the session's key, their numbers of characters brought up to date.

    Null and empty texts stay as they are; repeated rows stay as often; an empty table stays empty.
    """
    return pii.without_pii(docs, pii.session_key(spark)).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens.

    Null and empty texts are the end token alone; repeated rows are packed as often; an empty table gives an empty one.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", pack),
]

#: The stages learn and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage has written on its way goes when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope() as made:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = keep(docs, name.replace(" ", "-"))
            sweep(spark, made, docs)
    return docs
