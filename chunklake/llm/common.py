"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of an Arrow kernel handles at once; bounds the memory of a Python worker.
SLICE_BYTES = 4 << 20

#: Ids that are broadcast at most: 16 MB of rows.
BROADCAST_IDS = 1_000_000

LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables, seen by the driver and all executors; it goes when the session's JVM ends.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``, or else in the checkpoint
    folder of the session. Only a local master may have neither; it gets a temporary one.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if top is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tables-")
        sc.setCheckpointDir(top)
    folder = f"{top.rstrip('/')}/tables-{uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: nothing before it runs again if an executor is lost.

    Other than a checkpoint, the table has the size of its files as its estimate, so small ones are
    broadcast by Spark's own threshold and later stages get as many tasks as its bytes need.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table of ``cut`` that no plan needs any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def among(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or isn't (``left_anti``) in ``ids`` (id long, written by ``cut``).

    Null ids of ``docs`` are in nothing. Up to ``BROADCAST_IDS`` ids, counted first, are broadcast, so
    the texts stay where they are; more are met by a shuffle join.
    """
    ids = ids.select(F.col("id").alias("_id"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col].cast("long") == ids["_id"], how)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes in each; one row may exceed it."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def crc_mod(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``: the fixed fold of a row (null ids: fold of '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, the first by a hash of ``key``; the same rows on every run."""
    order = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    return df.withColumn("_h", order).orderBy("_h", key).limit(most).drop("_h")
