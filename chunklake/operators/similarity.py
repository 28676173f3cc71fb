"""Near-identical blocks: features, candidates and deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.functions import kernels


def features(blocks: DataFrame) -> DataFrame:
    """(chunk_id, slot, f) of (chunk_id, payload); blocks under 1 KiB have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                ids, slots, values = [], [], []
                for cid, data in zip(b.column(0)[i : i + 64].to_pylist(), b.column(1)[i : i + 64].to_pylist(), strict=True):
                    for slot, f in enumerate(kernels.block_features(data)):
                        ids.append(cid)
                        slots.append(slot)
                        values.append(f)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(slots, pa.int32()), pa.array(values, pa.int64())], ["chunk_id", "slot", "f"])

    big = blocks.select("chunk_id", "payload").filter(F.octet_length("payload") >= kernels.DELTA_LEAST)
    return big.mapInArrow(run, "chunk_id string, slot int, f long")


def newest_bases(known: DataFrame) -> DataFrame:
    """(f, base_id): of each feature the newest block alone, so a feature that many blocks share is one row in the join."""
    return known.groupBy("f").agg(F.max_by("chunk_id", F.struct("log_pos", "chunk_id")).alias("base_id"))


def candidates(probes: DataFrame, known: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """(chunk_id, base_id): for each probe block the base of its first feature slot that has one, itself left out.

    ``known``: features with log_pos. With ``usable`` (chunk_id), a slot whose newest base isn't usable is skipped;
    older bases of the slot aren't tried.
    """
    hits = probes.select("chunk_id", "slot", "f").join(newest_bases(known), "f").filter("base_id <> chunk_id")
    if usable is not None:
        hits = hits.join(usable.select(F.col("chunk_id").alias("base_id")), "base_id", "left_semi")
    return hits.groupBy("chunk_id").agg(F.min_by("base_id", "slot").alias("base_id"))


def set_candidates(probes: DataFrame) -> DataFrame:
    """Candidates within one batch: the base of a feature is its smallest block, and a base is never a delta itself."""
    base = probes.groupBy("f").agg(F.min("chunk_id").alias("base_id"))
    hits = probes.join(base, "f").filter("base_id <> chunk_id").groupBy("chunk_id").agg(F.min_by("base_id", "slot").alias("base_id"))
    return hits.join(hits.select(F.col("chunk_id").alias("base_id")), "base_id", "left_anti").select("chunk_id", "base_id")


def encode(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chunk_id, base_id, size, delta): the pairs for which a delta pays, by its size and after it was read back."""
    own = blocks.select("chunk_id", F.col("payload").alias("block"))
    base = blocks.select(F.col("chunk_id").alias("base_id"), F.col("payload").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows = [(c, p, len(x), kernels.encode_delta(x, y)) for c, p, x, y in zip(*(k[i : i + 64].to_pylist() for k in b.columns), strict=True)]
                rows = [r for r in rows if r[3] is not None]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["chunk_id", "base_id", "size", "delta"])

    return pairs.join(own, "chunk_id").join(base, "base_id").select("chunk_id", "base_id", "block", "base").mapInArrow(run, "chunk_id string, base_id string, size long, delta binary")


def decode(deltas: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chunk_id, payload) of deltas, from bases that are whole; depth one, so one join."""
    base = blocks.select(F.col("chunk_id").alias("base_id"), F.col("payload").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kernels.decode_delta(d, base, n) for _, d, base, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["chunk_id", "payload"])

    return deltas.join(base, "base_id").select("chunk_id", "delta", "base", "size").mapInArrow(run, "chunk_id string, payload binary")


def rebase_candidates(orphans: DataFrame, index: DataFrame, known: DataFrame, live: DataFrame) -> DataFrame:
    """For the deltas of orphan bases: another base that is live, whole and not one of the orphans."""
    deltas = index.filter("is_delta").join(orphans.select("base_id"), "base_id", "left_semi")
    usable = index.filter("not is_delta").join(live, "chunk_id", "left_semi").join(orphans.select(F.col("base_id").alias("chunk_id")), "chunk_id", "left_anti")
    return candidates(known.join(deltas.select("chunk_id"), "chunk_id", "left_semi"), known, usable)
