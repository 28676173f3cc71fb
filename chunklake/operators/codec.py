"""Frames through codecs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunklake.functions import kernels
from chunklake.operators.chunking import sliced


@F.pandas_udf(T.StructType([T.StructField("codec", T.IntegerType()), T.StructField("data", T.BinaryType())]))
def frame_form(data: pd.Series) -> pd.DataFrame:
    forms = [kernels.frame_form(bytes(d or b"")) for d in data]
    return pd.DataFrame({"codec": [f[0] for f in forms], "data": [f[1] for f in forms]})


@F.pandas_udf(T.BinaryType())
def unframe(codec: pd.Series, data: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([bytes(d) if c == 0 else kernels.decompress(bytes(d), int(n)) for c, d, n in zip(codec, data, size, strict=True)])


@F.pandas_udf(T.BooleanType())
def worth_compressing(data: pd.Series) -> pd.Series:
    return pd.Series([kernels.worth_compressing(bytes(d or b"")) for d in data])


@F.pandas_udf(T.StructType([T.StructField("plain", T.BinaryType()), T.StructField("level", T.IntegerType())]))
def unzlib(data: pd.Series) -> pd.DataFrame:
    found = [kernels.unzlib(bytes(d or b"")) or (None, None) for d in data]
    return pd.DataFrame({"plain": [f[0] for f in found], "level": pd.array([f[1] for f in found], dtype="Int32")})


@F.pandas_udf(T.BinaryType())
def rezlib(plain: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([zlib.compress(bytes(p), int(n)) for p, n in zip(plain, level, strict=True)])


def build_frames(packed: DataFrame, payloads: DataFrame) -> DataFrame:
    """(writer, frame, raw_len, codec, data) of packed blocks (writer, frame, ord, seq, chunk_id): a frame is about 1 MiB.

    A worker holds one frame at a time.
    """
    parts = packed.join(payloads, "chunk_id").select("writer", "frame", "ord", "seq", "payload")

    def build(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("ord", "seq", "payload")), strict=True), key=lambda r: [(v is not None, v) for v in r])
        values = [r[2] for r in rows]
        raw = None if None in values else b"".join(values)
        form, data = kernels.frame_form(raw or b"")
        head = t.select(["writer", "frame"]).slice(0, 1)
        for name, value in (("raw_len", pa.array([None if raw is None else len(raw)], pa.int64())), ("codec", pa.array([form], pa.int32())), ("data", pa.array([data], pa.binary()))):
            head = head.append_column(name, value)
        return head

    schema = T.StructType([*parts.select("writer", "frame").schema.fields, T.StructField("raw_len", T.LongType()), T.StructField("codec", T.IntegerType()), T.StructField("data", T.BinaryType())])
    return parts.groupBy("writer", "frame").applyInArrow(build, schema)


def recompress(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """``frames`` (seg, …, codec, raw_len, data) of the chosen segments, fast ones compressed at the highest level.

    Such a frame gets codec 2 even without a gain, so that a second round leaves it alone. Frames pass
    one at a time: a worker holds a batch as it is stored, one frame's raw bytes and a few MB of results.
    """
    f = frames.join(segments.select("seg"), "seg", "left_semi")
    codec, size, data = (f.columns.index(c) for c in ("codec", "raw_len", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sliced(b, data, 2 << 20):
                codecs, values = s.column(codec).to_pylist(), []
                for c, n, old in zip(codecs, s.column(size), s.column(data), strict=True):
                    new = old = old.as_py()
                    if c == 1:
                        new = kernels.compress(kernels.decompress(old, n.as_py()), 19)
                    values.append(new if c == 1 and len(new) < len(old) else old)
                columns = [*s.columns]
                columns[codec] = pa.array([2 if c == 1 else c for c in codecs], s.column(codec).type)
                columns[data] = pa.array(values, s.column(data).type)
                yield pa.RecordBatch.from_arrays(columns, s.schema.names)

    return f.mapInArrow(run, f.schema)


#: Strategies that codec_bench compares.
STRATEGIES = ("zstd-1", "zstd-3", "zstd-19", "zlib-6")


def _squeeze(strategy: str, data: bytes) -> tuple[int, bool]:
    kind, level = strategy.split("-")
    if kind == "zlib":
        out = zlib.compress(data, int(level))
        return len(out), zlib.decompress(out) == data
    out = kernels.compress(data, int(level))
    return len(out), kernels.decompress(out, len(data)) == data


def codec_bench(contents: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(strategy, files, original_bytes, out_bytes, ratio, lossless, best) over all contents; best: the least bytes among
    lossless strategies, the first of equals."""

    @F.pandas_udf("array<struct<strategy:string,out:long,lossless:boolean>>")
    def tried(data: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("strategy", "out", "lossless"), (s, *_squeeze(s, bytes(d))), strict=True)) for s in strategies] for d in data])

    rows = contents.select(F.octet_length("content").cast("long").alias("size"), F.explode(tried("content")).alias("t"))
    out = rows.groupBy(F.col("t.strategy").alias("strategy")).agg(F.count("*").alias("files"), F.sum("size").alias("original_bytes"), F.sum("t.out").alias("out_bytes"), F.min(F.col("t.lossless").cast("int")).alias("ok"))
    order = F.array_position(F.array(*map(F.lit, strategies)), F.col("strategy"))
    best = out.filter("ok = 1").agg(F.min_by("strategy", F.struct("out_bytes", order.alias("o"))).alias("b"))  # one row
    return out.crossJoin(best).select("strategy", "files", "original_bytes", "out_bytes", F.round(F.col("out_bytes") / F.nullif(F.col("original_bytes"), F.lit(0)), 6).alias("ratio"), (F.col("ok") == 1).alias("lossless"), (F.col("strategy") == F.col("b")).alias("best"))
