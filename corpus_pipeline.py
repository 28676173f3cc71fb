"""A training-corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm import decontam, mixing, quality, shards, simhash
from chunklake.llm.queries import DOMAINS, TARGETS


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours accept; rejected ones (score under 0.5, blank texts too) go."""
    labels = quality.learn_fold(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, quality.fit(docs, labels), score_col="_score").filter(F.col("_score") >= 0.5).drop("_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes: nine tenths of the tokens by target weights, no document twice."""
    return mixing.taken(docs, share=0.9, max_epochs=1, weights=TARGETS, domains=DOMAINS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document: shard 0 to 23, and its slot there."""
    return shards.shard(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: SQL can't express the classifier or the fingerprints; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    from chunklake.llm.common import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (_name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
