"""Blocks of contents, and which of them are new."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunklake.functions import kernels


def sliced(b: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch in which ``column`` holds about ``most`` bytes; one row may exceed it."""
    start = held = 0
    for i, v in enumerate(b.column(column)):
        n = len(v.as_buffer()) if v.is_valid else 0
        if held + n > most and i > start:
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < b.num_rows:
        yield b.slice(start)


def chunk(contents: DataFrame, payload: bool = False) -> DataFrame:
    """Blocks of (content_id, ord, content binary): content_id, ord, seq, chunk_id, start, len, and the bytes if asked.

    Each content is cut whole in its own task; no shuffle. Null and empty contents have no blocks.
    """
    names = ["content_id", "ord", "seq", "chunk_id", "start", "len"] + ["payload"] * payload
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in sliced(b, 2)):
            rows = []
            for cid, at, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start = 0
                for seq, end in enumerate(kernels.cut_points(data or b"")):
                    part = data[start:end]
                    rows.append((cid, at, seq, sha256(part).hexdigest(), start, end - start, *([part] * payload)))
                    start = end
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "content_id string, ord long, seq int, chunk_id string, start long, len long" + ", payload binary" * payload
    return contents.select("content_id", F.col("ord").cast("long").alias("ord"), F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def new_chunks(chunks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The first occurrence, by (ord, seq), of each block that the index hasn't: an aggregate, not a window, so a
    block that every content holds is one row after the map side."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    first = chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*rest), F.struct("ord", "seq")).alias("r")).select("chunk_id", *(F.col(f"r.{c}").alias(c) for c in rest))
    return first if index is None else first.join(index.select("chunk_id"), "chunk_id", "left_anti")


def put_results(contents: DataFrame, chunks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """What storing each content came to: blocks, new blocks and bytes, and the hit rate (0 without blocks).

    A block repeated within a content is new once.
    """
    new = new_chunks(chunks, index).groupBy("content_id").agg(F.count("*").alias("new_chunks"), F.sum("len").alias("new_bytes"))
    every = chunks.groupBy("content_id").agg(F.count("*").alias("chunks"), F.sum("len").alias("size"))
    out = contents.select("content_id").join(every, "content_id", "left").join(new, "content_id", "left").na.fill(0, ["chunks", "size", "new_chunks", "new_bytes"])
    rate = F.when(F.col("chunks") > 0, (F.col("chunks") - F.col("new_chunks")) * 100.0 / F.nullif(F.col("chunks"), F.lit(0))).otherwise(0.0)
    return out.withColumn("hit_rate", F.round(rate, 6))


def reconstruct(recipes: DataFrame, payloads: DataFrame) -> DataFrame:
    """(content_id, content, ok): contents from their blocks; ok if each block's hash and the whole one's are right.

    ``payloads``: (chunk_id, payload). A content is one row at its end anyway, so its blocks meet in one group.
    """
    joined = recipes.select("content_id", "seq", "chunk_id", "len").join(payloads, "chunk_id", "left")
    good = F.coalesce(F.sha2("payload", 256) == F.col("chunk_id"), F.lit(False))
    parts = joined.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("parts"), F.min(good.cast("int")).alias("good"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, F.coalesce(p["payload"], F.lit(b""))))
    out = parts.select("content_id", whole.alias("content"), "good")
    return out.select("content_id", "content", ((F.col("good") == 1) & (F.sha2("content", 256) == F.col("content_id"))).alias("ok"))


def read_ranges(blocks: DataFrame, payloads: DataFrame) -> DataFrame:
    """(content_id, content): the bytes of blocks_of_range(), put together."""
    part = F.expr("substring(payload, cast(skip as int) + 1, cast(take as int))")
    joined = blocks.join(payloads, "chunk_id").select("content_id", "seq", part.alias("part"))
    parts = joined.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("p"))
    return parts.select("content_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["part"])).alias("content"))


def pack_frames(chunks: DataFrame, frame_size: int, writer: str = "writer") -> DataFrame:
    """``chunks`` (…, writer, ord, seq, len) with ``frame``: blocks fill a frame until it reaches ``frame_size``, then a
    new one begins. The cut depends on all cuts before, so a writer's blocks pass through one group; deal the rows to
    many writers (a hash of the content, say) for large stores."""
    kept = chunks.select(writer, "ord", "seq", "chunk_id", F.col("len").cast("long").alias("len"))

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ord", "ascending"), ("seq", "ascending")])
        frames, held, k = [], 0, 0
        for n in t.column("len").to_pylist():
            frames.append(k)
            held += n
            if held >= frame_size:
                held, k = 0, k + 1
        return t.append_column("frame", pa.array(frames, pa.int32()))

    schema = T.StructType([*kept.schema.fields, T.StructField("frame", T.IntegerType())])
    return kept.groupBy(writer).applyInArrow(cut, schema)


def stored_shares(packed: DataFrame, frames: DataFrame, record: int = 56) -> DataFrame:
    """Disk bytes that each content is charged for: of each frame, by whole division, its share of raw bytes.

    ``packed``: (writer, frame, content_id, len); ``frames``: (writer, frame, raw_len, disk, chunks).
    """
    disk = F.col("disk") + F.lit(record) * F.col("chunks")
    own = packed.groupBy("writer", "frame", "content_id").agg(F.sum("len").alias("raw"))
    own = own.join(frames, ["writer", "frame"]).withColumn("all", disk)
    return own.withColumn("share", F.expr("`all` * raw div raw_len")).groupBy("content_id").agg(F.sum("share").alias("stored_disk"))


def contents_of(df: DataFrame, value: str, order: str) -> DataFrame:
    """(content_id, ord, content): distinct values of a text or binary column by hash, with the first place."""
    raw = F.col(value).cast("binary")
    rows = df.select(F.sha2(raw, 256).alias("content_id"), F.col(order).cast("long").alias("ord"), raw.alias("content")).filter("content is not null")
    return rows.groupBy("content_id").agg(F.min("ord").alias("ord"), F.any_value("content").alias("content"))
