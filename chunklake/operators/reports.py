"""Reports over the catalog: what is stored, what is saved, and by which codebook or package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.functions import scalars


def _first(df: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with a flag on the first row, by ord, of each key: found by an aggregate that combines before the shuffle."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min("ord").alias("_first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(flag, F.col("ord") == F.col("_first")).drop("_key", "_first")


def keyed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("content_key", scalars.content_key(F.col("storage"), F.col("id"), F.col("pack_file")))


def _row_ratio():
    return F.when(F.col("size") > 0, F.col("stored_size").cast("double") / F.nullif(F.col("size"), F.lit(0)).cast("double") * 100)


def stats(entries: DataFrame) -> DataFrame:
    """One row over the catalog. Stored bytes count each content key once, from its first entry; the mean ratio is that
    of the rows with bytes, each alike. Per key sums come first, so a popular content is one row in the last step."""
    by_id = entries.groupBy("id").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min_by("size", "ord").alias("one"), F.sum(_row_ratio()).alias("ratios"), F.count_if(F.col("size") > 0).alias("filled"))
    by_key = keyed(entries).groupBy("content_key").agg(F.min_by("stored_size", "ord").alias("stored"))
    a = by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.count("*").alias("unique_contents"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum("one"), F.lit(0)).alias("unique_bytes"),
        F.coalesce(F.sum("size") - F.sum("one"), F.lit(0)).alias("dedup_saved_bytes"),
        F.round(F.coalesce(F.sum("ratios") / F.nullif(F.sum("filled"), F.lit(0)), F.lit(0.0)), 6).alias("avg_ratio"),
    )
    return a.crossJoin(by_key.agg(F.coalesce(F.sum("stored"), F.lit(0)).alias("stored_bytes")))  # one row beside one row


def codebook_stats(entries: DataFrame, codebooks: DataFrame) -> DataFrame:
    """A row for each codebook in use: members, contents and bytes credited to the codebook of the first entry of each
    content key, savings (which may be negative) and mean hit rate; the default first, then by savings."""
    e = _first(keyed(entries).withColumn("book", scalars.codebook_name(F.col("codebook"))), "content_key", "is_first")
    once = F.col("is_first")
    out = e.groupBy("book").agg(
        F.count("*").alias("members"),
        F.count_if(once).alias("unique_contents"),
        F.sum("size").alias("original_bytes"),
        F.coalesce(F.sum(F.when(once, F.col("stored_size"))), F.lit(0)).alias("stored_bytes"),
        F.round(F.avg("hit_rate"), 6).alias("avg_hit"),
    )
    books = codebooks.select(F.col("name").alias("book"), F.col("size").alias("db_size"), "is_default")
    out = out.join(books, "book", "left")
    saved = F.col("original_bytes") - F.col("stored_bytes")
    return out.select(
        F.col("book").alias("codebook"), "members", "unique_contents", "original_bytes", "stored_bytes", saved.alias("saved_bytes"),
        F.round(scalars.percent(F.col("stored_bytes"), F.col("original_bytes")), 6).alias("ratio"), "avg_hit",
        F.coalesce("db_size", F.lit(0)).alias("db_size"), F.coalesce("is_default", F.lit(False)).alias("is_default"),
    ).orderBy(F.desc("is_default"), F.desc("saved_bytes"), "codebook")


def package_report(entries: DataFrame, names: int = 6) -> DataFrame:
    """A row for each package in the order first seen: sums over all members, repeats included, the first member's
    codebook, and the first base names."""
    e = entries.withColumn("package", F.when(F.col("group") == "", F.col("name")).otherwise(F.col("group")))
    first = Window.partitionBy("package").orderBy("ord")
    top = e.select("package", "ord", scalars.base_name(F.col("rel_path")).alias("base")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= names)
    top = top.groupBy("package").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "base"))), lambda x: x["base"]), ",").alias("first_names"))
    sums = e.groupBy("package").agg(
        F.count("*").alias("files"), F.sum("size").alias("original_bytes"), F.sum("stored_size").alias("stored_bytes"),
        F.min_by("codebook", "ord").alias("codebook"), F.min("ord").alias("first_ord"),
    )
    return sums.join(top, "package").withColumn("ratio", F.round(scalars.percent(F.col("stored_bytes"), F.col("original_bytes")), 6)).orderBy("first_ord")


def store_stats(index: DataFrame, live_contents: DataFrame, frames: DataFrame, block: int = 512) -> DataFrame:
    """One row over the store; allocated bytes are modelled as whole blocks of a segment."""
    seg = frames.groupBy("seg").agg(F.sum("comp_len").alias("bytes"))
    disk = seg.agg(F.count("*").alias("segments"), F.coalesce(F.sum(F.ceil(F.col("bytes") / block) * block), F.lit(0)).cast("long").alias("allocated_bytes"))
    return index.agg(F.count("*").alias("chunks")).crossJoin(live_contents.agg(F.count("*").alias("contents"))).crossJoin(disk)


def content_info(recipes: DataFrame) -> DataFrame:
    """Of each content: blocks, distinct blocks, bytes and mean bytes of a block."""
    return recipes.groupBy("content_id").agg(F.count("*").alias("chunks"), F.countDistinct("chunk_id").alias("distinct_chunks"), F.sum("len").alias("size")).withColumn("mean_chunk", F.expr("size div greatest(1, chunks)"))


def duplicates(entries: DataFrame) -> DataFrame:
    """Contents that several entries share, with the bytes that sharing saves."""
    out = entries.groupBy("id").agg(F.count("*").alias("copies"), F.min("ord").alias("first_ord"), (F.sum("size") - F.min_by("size", "ord")).alias("saved_bytes"))
    return out.filter(F.col("copies") > 1)


def rollup(entries: DataFrame) -> DataFrame:
    """Extension: files and bytes by package and language, with subtotals and a total."""
    lang = F.split_part(F.col("rel_path"), F.lit("/"), F.lit(1))
    out = entries.withColumn("lang", lang).rollup("group", "lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.grouping_id().alias("level"))
    return out.select(F.col("group").alias("package"), "lang", "files", "bytes", F.col("level").cast("int").alias("level"))
