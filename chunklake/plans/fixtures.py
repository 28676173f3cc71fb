"""Catalog and block-store tables derived from the test tables, for queries; the same rules in SQL are in catalog_sql."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions import scalars

#: Characters of a piece, in the fixture's own cut of long texts.
PIECE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(column: str, start: int, n: int) -> Column:
    return F.conv(F.substring(column, start, n), 16, 10).cast("long")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a logical file of the package named by its source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    size = F.octet_length("text").cast("long")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
    rel = F.concat("lang", F.lit("/"), name)
    folder = F.concat(F.lit("/arquivos/"), F.col("source"))
    return d.select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("uid"),
        F.sha2("text", 256).alias("id"),
        name.alias("name"),
        F.col("source").alias("group"),
        rel.alias("rel_path"),
        folder.alias("folder"),
        F.concat(folder, F.lit("/"), rel).alias("path"),
        F.lit(True).alias("is_dir"),
        F.concat(F.lit("/src/"), "source", F.lit("/"), rel).alias("source_path"),
        size.alias("size"),
        F.concat(F.sha2("text", 256), F.lit(".pack")).alias("pack_file"),
        (F.floor(size * 37 / 100) + 64).cast("long").alias("stored_size"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise("blocks").alias("storage"),
        F.when(F.col("lang") == "en", "/codebooks/vault.codebook").when(F.col("lang") == "fr", "/codebooks/fr.codebook").otherwise("").alias("codebook"),
        ((F.col("doc_id") * 7) % 101).cast("double").alias("hit_rate"),
        F.when(F.col("doc_id") % 10 == 0, 493).otherwise(420).alias("mode"),
        (F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)).alias("packed_at"),
        F.lit(True).alias("verified"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, ord, text): each distinct text with its first place."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_id"), "doc_id", "text")
    return d.groupBy("content_id").agg(F.min("doc_id").alias("ord"), F.min("text").alias("text"))


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, ord, seq, chunk_id, len): the fixture's pieces of each content."""
    piece = F.expr(f"transform(sequence(0, greatest(length(text) - 1, 0) div {PIECE}), i -> substring(text, i * {PIECE} + 1, {PIECE}))")
    parts = contents(spark, sf_dir).filter("text <> ''").select("content_id", "ord", F.posexplode(piece).alias("seq", "piece"))
    return parts.select("content_id", "ord", "seq", F.sha2("piece", 256).alias("chunk_id"), F.octet_length("piece").cast("long").alias("len"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the distinct pieces lie, by arithmetic on their hashes; one in eight is a delta on the frame's first whole piece."""
    c = recipes(spark, sf_dir).groupBy("chunk_id").agg(F.max("len").alias("size"))
    c = c.select(
        "chunk_id",
        (_hex("chunk_id", 1, 2) % 8).cast("int").alias("seg"),
        (_hex("chunk_id", 3, 2) % 16 * 1048576).alias("frame_off"),
        (_hex("chunk_id", 5, 1) < 2).alias("d"),
        "size",
        _hex("chunk_id", 6, 7).alias("log_pos"),
    )
    first = c.filter(~F.col("d")).groupBy("seg", "frame_off").agg(F.min("chunk_id").alias("base"))
    c = c.join(first, ["seg", "frame_off"], "left")
    is_delta = F.col("d") & F.col("base").isNotNull()
    return c.select("chunk_id", "seg", "frame_off", "size", is_delta.alias("is_delta"), F.when(is_delta, F.col("base")).alias("base_id"), "log_pos")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the index, with bytes of their own; one in each segment holds only dead bytes."""
    i = chunk_index(spark, sf_dir).groupBy("seg", "frame_off").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    raw = (F.col("size") + F.col("n") * 32 + F.when(F.col("seg") % 3 == 0, F.col("size")).otherwise(0)).cast("long")
    rows = i.select("seg", "frame_off", (F.col("seg") % 3).cast("int").alias("codec"), raw.alias("raw_len"), F.floor(raw * 2 / 5).cast("long").alias("comp_len"))
    dead = i.select("seg").distinct().select("seg", F.lit(99 * 1048576).cast("long").alias("frame_off"), F.lit(1).alias("codec"), F.lit(1000).cast("long").alias("raw_len"), F.lit(400).cast("long").alias("comp_len"))
    return rows.union(dead)


def recipe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the recipes: every content is put, some deleted, some of those put again; some records are bad."""
    c = contents(spark, sf_dir).select("content_id", "ord", (F.octet_length("text") <= 4096).alias("one"))
    ops = [(0, F.when(F.col("one"), 3).otherwise(1), F.lit(True)), (1, F.lit(2), F.col("ord") % 7 == 0), (2, F.when(F.col("one"), 3).otherwise(1), F.col("ord") % 14 == 0)]
    out = None
    for k, op, when in ops:
        part = c.filter(when).select((F.col("ord") * 3 + k).alias("log_pos"), op.alias("op"), "content_id", (F.col("ord") % 50 == 3).alias("bad"))
        out = part if out is None else out.union(part)
    return out


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features of each indexed piece, from its hash, so that some pieces share one."""
    i = chunk_index(spark, sf_dir)
    values = F.array(*(F.struct(F.lit(k).alias("slot"), (_hex("chunk_id", 8 + 4 * k, 3) % 500 + k * 1000).alias("f")) for k in range(3)))
    return i.select("chunk_id", "log_pos", F.explode(values).alias("v")).select("chunk_id", "v.slot", "v.f", "log_pos")


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the entries with all above them, one empty folder, and two of the trash."""
    e = entries(spark, sf_dir).select("folder").distinct()
    deep = e.select(F.explode(scalars.ancestors(F.col("folder"))).alias("path"))
    more = spark.createDataFrame([("/arquivos/empty/deep",), ("/notes",), ("/.Trash-1000",), ("/arquivos/.Trash/x",)], "path string")
    return deep.union(more).distinct()


def codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("vault", 2048, True), ("spare", 512, False)], "name string, size long, is_default boolean")


def pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of packed entries, some missing, and some that no entry names."""
    e = entries(spark, sf_dir).filter("storage = ''")
    kept = e.filter("ord % 15 <> 0").select(F.col("pack_file").alias("file"), F.col("stored_size").alias("size"))
    loose = e.filter("ord % 20 = 0").select(F.concat(F.lit("loose-"), "pack_file").alias("file"), F.col("size"))
    return kept.union(loose).distinct()


def merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalog on disk, and a local one with marks of what it changed and deleted."""
    e = entries(spark, sf_dir).select("ord", "uid", "id", "name", "path")
    disk = e.filter("ord % 10 <> 0")
    local = e.filter("ord % 10 <> 1").select("ord", "uid", "id", F.concat(F.lit("local_"), "name").alias("name"), "path", (F.col("ord") % 3 == 0).alias("is_dirty"), (F.col("ord") % 11 == 0).alias("is_deleted"))
    return disk, local
