"""The block store as tables: logs, liveness, garbage, and the plan of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, key: str, position: str = "log_pos") -> DataFrame:
    """The last record of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def live_recipes(log: DataFrame) -> DataFrame:
    """Contents whose last good record isn't a deletion."""
    return newest(log.filter(~F.col("bad")).drop("bad"), "content_id").filter("op <> 2")


def log_health(log: DataFrame) -> DataFrame:
    """One row: records, bad ones, good ones that a later one replaces, deletions that stand."""
    last = newest(log.filter(~F.col("bad")).drop("bad"), "content_id").agg(F.count("*").alias("standing"), F.count_if(F.col("op") == 2).alias("deleted"))
    every = log.agg(F.count("*").alias("records"), F.count_if(F.col("bad")).alias("bad_records"))
    return every.crossJoin(last).select("records", "bad_records", (F.col("records") - F.col("bad_records") - F.col("standing") + F.col("deleted")).alias("dead_records"), "deleted")


def offsets(recipes: DataFrame) -> DataFrame:
    """``recipes`` with the byte at which each block starts in its content."""
    before = Window.partitionBy("content_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return recipes.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long"))


def blocks_of_range(recipes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks that a read of (content_id, off, n) touches: block, and the part of it (skip, take).

    An equi-join on the content keeps the range test within its own blocks; reads past the end stop there.
    """
    asked = ranges.filter("off >= 0 and n > 0")
    at = offsets(recipes.join(asked.select("content_id").distinct(), "content_id", "left_semi")).join(asked, "content_id")
    at = at.filter((F.col("start") < F.col("off") + F.col("n")) & (F.col("start") + F.col("len") > F.col("off")))
    skip = F.greatest(F.col("off") - F.col("start"), F.lit(0))
    return at.select("content_id", "seq", "chunk_id", skip.alias("skip"), (F.least(F.col("len"), F.col("off") + F.col("n") - F.col("start")) - skip).alias("take"))


def damaged_recipes(contents: DataFrame, recipes: DataFrame, index: DataFrame) -> DataFrame:
    """(content_id) of ``contents`` (content_id, size) whose recipe can't be followed: it is missing or has gaps, its lengths
    don't add up to the size, or it names a block that the index doesn't have."""
    lost = recipes.join(index.select("chunk_id"), "chunk_id", "left_anti").select("content_id").distinct().withColumn("lost", F.lit(True))
    sums = recipes.groupBy("content_id").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("places"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.sum("len").alias("bytes"))
    every = contents.select("content_id", "size").distinct().join(sums, "content_id", "left").join(lost, "content_id", "left")
    whole = (F.col("n") == F.col("places")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("bytes") == F.col("size")) & F.col("lost").isNull()
    return every.filter(~F.coalesce(whole, F.col("size") == 0)).select("content_id")


def mark_live(index: DataFrame, recipes: DataFrame) -> DataFrame:
    """Blocks that must stay: those of the recipes, and the bases of all indexed deltas, of dead ones too."""
    return recipes.select("chunk_id").union(index.filter("is_delta").select(F.col("base_id").alias("chunk_id"))).distinct()


def garbage(index: DataFrame, live: DataFrame) -> DataFrame:
    return index.join(live, "chunk_id", "left_anti").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def orphan_bases(index: DataFrame, recipes: DataFrame) -> DataFrame:
    """Bases that no recipe names but live deltas need: with the number of those and their bytes."""
    used = recipes.select("chunk_id").distinct()
    deltas = index.filter("is_delta").join(used, "chunk_id", "left_semi")
    loose = deltas.join(used.withColumnRenamed("chunk_id", "base_id"), "base_id", "left_anti")
    base = index.select(F.col("chunk_id").alias("base_id"), F.col("size").alias("base_size"))
    out = loose.groupBy("base_id").agg(F.count("*").alias("deltas"), F.sum("size").alias("delta_bytes"))
    return out.join(base, "base_id", "left")


def rebase_worth(orphans: DataFrame, replacements: DataFrame) -> DataFrame:
    """Orphan bases to give up: keeping costs the base and its deltas, changing costs the replacements (base_id, len)."""
    change = replacements.groupBy("base_id").agg(F.sum("len").alias("change"))
    keep = F.coalesce("base_size", F.lit(0)) + F.col("delta_bytes")
    return orphans.withColumn("keep", keep).join(change, "base_id").withColumn("apply", F.col("change") < F.col("keep"))


def frame_usage(frames: DataFrame, index: DataFrame, live: DataFrame) -> DataFrame:
    """(seg, frame_off, all_bytes, live_bytes): all from the frame's own header, live from the index."""
    alive = index.join(live, "chunk_id", "left_semi").groupBy("seg", "frame_off").agg(F.sum("size").alias("live_bytes"))
    return frames.select("seg", "frame_off", F.col("raw_len").alias("all_bytes")).join(alive, ["seg", "frame_off"], "left").withColumn("live_bytes", F.coalesce("live_bytes", F.lit(0)))


def gc_frames(usage: DataFrame, min_dead: float) -> DataFrame:
    """``usage`` with what becomes of each frame: verbatim (kept as it is), or rewritten."""
    dead = F.col("all_bytes") - F.col("live_bytes")
    return usage.withColumn("verbatim", (F.col("live_bytes") > 0) & (dead.cast("double") < F.lit(float(min_dead)) * F.col("all_bytes")))


def gc_segments(usage: DataFrame, min_dead: float) -> DataFrame:
    """Of each segment: bytes in all, live, reclaimable, and whether it is rewritten."""
    f = gc_frames(usage, min_dead)
    reclaim = F.sum(F.when(~F.col("verbatim"), F.col("all_bytes") - F.col("live_bytes")).otherwise(0))
    s = f.groupBy("seg").agg(F.sum("all_bytes").alias("all_bytes"), F.sum("live_bytes").alias("live_bytes"), reclaim.alias("reclaim_bytes"))
    r = F.col("reclaim_bytes").cast("double") / F.nullif(F.col("all_bytes"), F.lit(0)).cast("double")
    rewrite = (F.col("all_bytes") == 0) | (F.col("live_bytes") == 0) | ((r > 0) & (r >= F.lit(float(min_dead))))
    return s.withColumn("rewrite", rewrite)


def gc_plan(index: DataFrame, frames: DataFrame, recipes: DataFrame, min_dead: float) -> DataFrame:
    """(chunk_id, fate): keep, copy (with its verbatim frame), move, or drop. Dead blocks of kept frames stay usable."""
    live = mark_live(index, recipes).withColumn("live", F.lit(True))
    usage = frame_usage(frames, index, live.select("chunk_id"))
    segs = gc_segments(usage, min_dead).select("seg", "rewrite")
    fr = gc_frames(usage, min_dead).select("seg", "frame_off", "verbatim")
    out = index.join(live, "chunk_id", "left").join(segs, "seg").join(fr, ["seg", "frame_off"])
    fate = F.when(~F.col("rewrite"), "keep").when(F.col("verbatim"), "copy").when(F.col("live"), "move").otherwise("drop")
    return out.select("chunk_id", "size", fate.alias("fate"))


def segment_budget(frames: DataFrame, most: int) -> DataFrame:
    """Segments for one round of recompression: those with a compressed frame, in order, while their sum stays within
    ``most`` bytes, and always one."""
    seg = frames.groupBy("seg").agg(F.sum("comp_len").alias("bytes"), F.max((F.col("codec") == 1).cast("int")).alias("todo")).filter("todo = 1")
    order = Window.orderBy("seg")  # a row for each segment file
    seg = seg.withColumn("upto", F.sum("bytes").over(order)).withColumn("n", F.row_number().over(order))
    return seg.filter((F.col("n") == 1) | (F.col("upto") <= most)).select("seg", "bytes", "upto")


def positions(index: DataFrame) -> DataFrame:
    """``index`` laid out by place, so that each frame is decoded once: ranges of (seg, frame) in order within partitions."""
    return index.repartitionByRange("seg", "frame_off").sortWithinPartitions("seg", "frame_off", "chunk_id")


def compact_features(features: DataFrame, index: DataFrame, least_garbage: float = 0.25, force: bool = False) -> DataFrame:
    """Feature rows of indexed blocks that aren't deltas, each once; the table as it is while under a quarter is garbage."""
    whole = index.filter("not is_delta").select("chunk_id")
    kept = features.join(whole, "chunk_id", "left_semi").dropDuplicates(["chunk_id", "slot", "f"])
    total, good = features.count(), kept.count()
    return kept if force or (total and (total - good) / total >= least_garbage) else features


def dangling_entries(entries: DataFrame, live: DataFrame) -> DataFrame:
    """Entries in the block store whose content has no recipe."""
    return entries.filter("storage = 'blocks'").join(live.select(F.col("content_id").alias("id")), "id", "left_anti")


def orphan_files(files: DataFrame, entries: DataFrame) -> DataFrame:
    return files.join(entries.filter("storage = ''").select(F.col("pack_file").alias("file")), "file", "left_anti")


def missing_codebooks(entries: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Entries whose codebook isn't there, by its name."""
    from chunklake.functions import scalars

    e = entries.withColumn("book", scalars.codebook_name(F.col("codebook"))).filter("book <> ''")
    return e.join(codebooks.select(F.col("name").alias("book")), "book", "left_anti")


def duplicate_uids(entries: DataFrame) -> DataFrame:
    return entries.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1")


def doctor(entries: DataFrame, log: DataFrame, index: DataFrame, recipes: DataFrame, files: DataFrame, codebooks: DataFrame) -> DataFrame:
    """(check, severity, n): what is wrong with a store, a row for each check."""
    live = live_recipes(log)
    current = recipes.join(live.select("content_id"), "content_id", "left_semi")
    checks = [
        ("bad_records", "error", log.filter("bad")),
        ("dangling_entries", "error", dangling_entries(entries, live)),
        ("duplicate_uids", "error", duplicate_uids(entries)),
        ("garbage_chunks", "info", index.join(mark_live(index, current), "chunk_id", "left_anti")),
        ("missing_codebooks", "warning", missing_codebooks(entries, codebooks)),
        ("no_default_codebook", "warning", codebooks.agg(F.count_if("is_default").alias("n")).filter("n = 0")),
        ("orphan_files", "warning", orphan_files(files, entries)),
    ]
    out = None
    for name, severity, rows in checks:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n")
        out = part if out is None else out.union(part)
    return out


def recipe_sums(recipes: DataFrame, contents: DataFrame) -> DataFrame:
    """Contents whose blocks don't add up to their size."""
    sums = recipes.groupBy("content_id").agg(F.sum("len").alias("total"))
    return contents.join(sums, "content_id", "left").filter(F.coalesce("total", F.lit(0)) != F.col("size"))


def roll_segments(frames: DataFrame, segment_size: int, writer: str = "writer") -> DataFrame:
    """``frames`` (writer, frame, disk) with ``roll``: a writer's frames fill a segment, and one that would pass
    ``segment_size`` begins the next. Sequential within a writer, as the cut depends on the cuts before."""
    from pyspark.sql import types as T

    kept = frames.select(writer, "frame", F.col("disk").cast("long").alias("disk"))

    def cut(pdf):
        pdf = pdf.sort_values("frame")
        out, held, k = [], 0, 0
        for n in pdf["disk"]:
            if held and held + n > segment_size:
                held, k = 0, k + 1
            held += n
            out.append(k)
        return pdf.assign(roll=out)

    return kept.groupBy(writer).applyInPandas(cut, T.StructType([*kept.schema.fields, T.StructField("roll", T.IntegerType())]))


def optimize_candidates(index: DataFrame, features: DataFrame, recipes: DataFrame, least: int = 1024) -> DataFrame:
    """Blocks that may still become deltas: live, whole, large enough, never scanned, no base, and not a content of one block."""
    one = recipes.groupBy("content_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).filter("n = 1").select("chunk_id")
    bases = index.filter("is_delta").select(F.col("base_id").alias("chunk_id"))
    out = index.filter(~F.col("is_delta") & (F.col("size") >= least)).join(recipes.select("chunk_id"), "chunk_id", "left_semi")
    for other in (features.select("chunk_id"), bases, one):
        out = out.join(other, "chunk_id", "left_anti")
    return out


def reference_counts(entries: DataFrame) -> DataFrame:
    """(pack_file, n): entries that name each packed file."""
    return entries.filter("storage = ''").groupBy("pack_file").agg(F.count("*").alias("n"))


def expired(pending: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Pending writes (…, modified) that nobody touched for so long."""
    return pending.filter(F.col("modified") < F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))


def approx_uniques(recipes: DataFrame) -> DataFrame:
    """Extension: about how many distinct blocks there are, in one pass without a shuffle of the blocks."""
    return recipes.agg(F.approx_count_distinct("chunk_id", 0.02).alias("chunks"), F.count("*").alias("references"))
