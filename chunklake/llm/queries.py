"""Queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm import audio, decontam, langid, line_dedup, main_text, mixing, quality, shards, simhash, toxicity
from chunklake.llm.common import crc_mod


#: The domains of the test tables' sources, and the target weights of domains and of languages in each; sources of one
#: language share by the root of their tokens.
DOMAINS = {f"src{i}": ("web", "web", "books", "news", "code")[i // 4] for i in range(20)}
TARGETS = {"web": 5, "books": 2, "news": 2, "code": 1, "other": 1, "*/en": 6, "*/fr": 2, "*/de": 2, "*/es": 2, "*/": 1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, F.col("source")).select("doc_id", "line_dedup.text", "line_dedup.n_lines", "line_dedup.n_dropped")


def op1_page_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over pages, by host: what stands between two tags is a line."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return line_dedup.drop_boilerplate(pages, line_dedup.host(F.col("url")), ratio=0.05).select("page_id", "line_dedup.text", "line_dedup.n_lines", "line_dedup.n_dropped")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the vectors of ``embeddings``, which are sounded as notes to stand in for recordings."""
    return audio.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", decode=audio.notes)


def op3_chroma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th recording searched among all: how many align with it, in how many classes, and the best."""
    return audio.summary(audio.search(_recordings(spark, sf_dir), F.col("id") % 20 == 0)).withColumnRenamed("id", "vec_id")


def op3_chroma_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with a row for each query and class that aligns with it."""
    return audio.search(_recordings(spark, sf_dir), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


def op3_chroma_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal fingerprints of every row, by which the search names what it finds."""
    return audio.membership(_recordings(spark, sf_dir)).withColumnRenamed("id", "vec_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        decontam.n_hit().alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (F.size("contamination.hits") > 0).alias("contaminated"),
    )


def benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the benchmark's passages lie in the original texts: a row for each run of hit words."""
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontam.with_spans(found).select("doc_id", F.explode("spans").alias("span")).select("doc_id", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = main_text.main_text(pages, main_text.fit(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, quality.learn_fold(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("toxicity.score").alias("score"), F.col("toxicity.spans").alias("spans"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), weights=TARGETS, domains=DOMAINS)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.learn_fold(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op1_page_boilerplate,
        op2_language_id,
        op3_chroma_search,
        op3_chroma_matches,
        op3_chroma_classes,
        op4_decontamination,
        benchmark_spans,
        op5_sharding,
        op6_main_text,
        op7_simhash_near_dedup,
        op8_toxicity,
        op9_mixing,
        op10_quality_classifier,
    )
}
