"""Schemas of the catalog and the block store."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _I, _B, _D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()

#: A logical file. ``ord`` is its place in the catalog: wherever the first or last wins, ``ord`` decides.
ENTRY = _of(
    ord=_L, uid=_S, id=_S, name=_S, group=_S, rel_path=_S, folder=_S, path=_S, is_dir=_B, source_path=_S, size=_L, pack_file=_S,
    stored_size=_L, storage=_S, codebook=_S, hit_rate=_D, mode=_L, pack_flags=T.ArrayType(_S), packed_at=T.TimestampType(), verified=_B,
)
#: One block of a content, in order.
RECIPE = _of(content_id=_S, seq=_I, chunk_id=_S, start=_L, len=_L)
#: Where a distinct block lies, and whether it is stored as a delta on another.
CHUNK_INDEX = _of(chunk_id=_S, seg=_I, frame_off=_L, off_in_frame=_L, size=_L, is_delta=_B, base_id=_S, log_pos=_L)
#: A compressed run of blocks. codec: 0 raw, 1 compressed, 2 compressed at the highest level.
FRAME = _of(seg=_I, frame_off=_L, codec=_I, raw_len=_L, comp_len=_L)
#: A change of the recipes. op: 1 put, 2 delete, 3 put of a content of one block.
RECIPE_LOG = _of(log_pos=_L, op=_I, content_id=_S, bad=_B)
#: One of the min-hash features of a block.
FEATURE = _of(chunk_id=_S, slot=_I, f=_L, log_pos=_L)
#: The kinds of a content's storage.
BLOCKS, PACKED = "blocks", ""
