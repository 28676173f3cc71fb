"""Files, manifests and packages as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake import schema
from chunklake.functions import scalars


def scan(spark: SparkSession, folder: str, content: bool = True, with_empty: bool = False) -> DataFrame:
    """(path, rel_path, size, modified, content_id, content) of all files below ``folder``; unreadable ones are left out.

    Spark's reader passes over files of no bytes. With ``with_empty`` they are rows too; the driver
    then lists the folder's names once more.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(folder)
    if with_empty:
        files = files.unionByName(_empty_files(spark, folder))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted("/" + folder.split(":", 1)[-1].strip("/") + "/"), "")
    out = files.select("path", rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_id"), "content")
    return out if content else out.drop("content", "content_id")


def _empty_files(spark: SparkSession, folder: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found, rows = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        if not f.getLen():
            rows.append((f.getPath().toString(), f.getModificationTime()))
    out = spark.createDataFrame(rows, "path string, ms long")
    return out.select("path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").cast("binary").alias("content"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in text)


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """(files, bytes) below a folder; contents aren't read."""
    return scan(spark, folder, content=False).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON-lines manifests, plain or compressed by suffix. Unknown keys are ignored, a torn record is an error,
    and missing uid, folder, path and storage are filled in; entries in the trash are dropped."""
    raw = spark.read.schema(schema.ENTRY).option("mode", "FAILFAST").json(path)
    folder = F.coalesce("folder", F.when(F.coalesce("group", F.lit("")) != "", F.concat(F.lit("/arquivos/"), "group")).otherwise("/"))
    out = raw.withColumn("folder", folder)
    out = out.withColumn("path", F.coalesce("path", scalars.canonical_path(F.col("folder"), F.coalesce("rel_path", "name"))))
    out = out.withColumn("uid", F.coalesce("uid", scalars.entry_uid(F.col("path"), F.coalesce("id", F.lit("")))))
    return out.withColumn("storage", F.coalesce("storage", F.lit(""))).filter(~scalars.is_trash(F.col("path")))


def write_manifest(entries: DataFrame, path: str) -> None:
    entries.write.option("compression", "gzip").json(path)


def export_group(entries: DataFrame, chunks: DataFrame, group: str, path: str) -> None:
    """A package as a folder: its entries by relative path, and the blocks (content_id, seq, chunk_id, payload) they need."""
    own = entries.filter(F.col("group") == group)
    own.orderBy("rel_path").write.parquet(f"{path}/entries")
    chunks.join(own.select(F.col("id").alias("content_id")), "content_id", "left_semi").write.parquet(f"{path}/blocks")


def bundle_members(entries: DataFrame) -> DataFrame:
    """(group, name, size, sha256) of each member of each package, a row each."""
    return entries.select("group", F.col("rel_path").alias("name"), "size", F.col("id").alias("sha256"))


def bundle_meta(entries: DataFrame) -> DataFrame:
    """(group, codebook, members, bytes, members_sum) of each package.

    members counts them; members_sum is the sum of the first 60 bits of the MD5 of "name:size:sha256" of
    each, which tells packages apart whatever the order. Partial sums only: a package of any size never
    meets in one row.
    """
    member = F.concat_ws(":", "rel_path", F.col("size").cast("string"), "id")
    part = F.conv(F.substring(F.md5(member), 1, 15), 16, 10).cast("decimal(38,0)")
    return entries.groupBy("group").agg(F.min_by("codebook", "ord").alias("codebook"), F.count("*").alias("members"), F.sum("size").alias("bytes"), F.sum(part).cast("string").alias("members_sum"))


def is_outside(path: Column) -> Column:
    """Whether a relative path is absolute or climbs with "..", so that it could leave the folder it is put in."""
    return F.coalesce(path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)") | path.contains("\x00"), F.lit(False))


def open_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/blocks")


def import_group(entries: DataFrame, new: DataFrame, group: str | None = None) -> DataFrame:
    """``entries`` with those of a package, under another name if given, in place of entries at the same paths."""
    from chunklake.operators.catalog import replace_entries

    if group is not None:
        folder = F.lit(f"/arquivos/{group}")
        new = new.withColumns({"group": F.lit(group), "folder": folder, "path": F.concat(folder, F.lit("/"), "rel_path")})
    return replace_entries(entries, new)


def bundle_errors(members: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Members (name, sha256) whose rebuilt content (content_id, content) is missing or has another hash."""
    got = rebuilt.select(F.col("content_id").alias("sha256"), F.sha2("content", 256).alias("is"))
    return members.join(got, "sha256", "left").filter(~F.col("sha256").eqNullSafe(F.col("is"))).select("name", "sha256")


def extract_plan(entries: DataFrame, existing: DataFrame, target: str, force: bool = False) -> DataFrame:
    """(ord, id, target, mode, status) of an extraction: each content goes to a target once; a target that exists is left
    alone unless forced. What would leave the target's folder by its group or path is ``refused``."""
    to = F.concat(F.lit(target.rstrip("/") + "/"), F.when(F.col("group") == "", F.col("rel_path")).otherwise(F.concat("group", F.lit("/"), "rel_path")))
    bad = is_outside(F.col("group")) | is_outside(F.col("rel_path"))
    e = entries.select("ord", "id", to.alias("target"), scalars.display_mode(F.col("mode")).alias("mode"), bad.alias("bad"))
    e = e.groupBy("id", "target").agg(F.min("ord").alias("ord"), F.min_by("mode", "ord").alias("mode"), F.max("bad").alias("bad"))
    e = e.join(existing.select("target", F.lit(True).alias("there")).distinct(), "target", "left")
    status = F.when(F.col("bad"), "refused").when(F.col("there") & F.lit(not force), "exists").otherwise("write")
    return e.select("ord", "id", "target", "mode", status.alias("status"))


def extract(plan: DataFrame, contents: DataFrame) -> DataFrame:
    """Write the planned files where the tasks run (a shared folder on a cluster): (target, ok) after reading each back."""
    import os
    from hashlib import sha256

    def write(batches):
        import pandas as pd

        for pdf in batches:
            done = []
            for t, mode, cid, data in zip(pdf.target, pdf["mode"], pdf.id, pdf.content, strict=True):
                os.makedirs(os.path.dirname(t), exist_ok=True)
                with open(t, "wb") as f:
                    f.write(bytes(data))
                os.chmod(t, int(mode))
                with open(t, "rb") as f:
                    done.append(sha256(f.read()).hexdigest() == cid)
            yield pd.DataFrame({"target": pdf.target, "ok": done})

    todo = plan.filter("status = 'write'").join(contents.select(F.col("content_id").alias("id"), "content"), "id")
    return todo.select("target", "mode", "id", "content").mapInPandas(write, "target string, ok boolean")
