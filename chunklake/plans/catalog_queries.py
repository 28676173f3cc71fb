"""Queries over the catalog and block store, by name. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions import scalars
from chunklake.operators import catalog, chunking, codec, reports, search, similarity, store
from chunklake.plans import fixtures as fx
from chunklake.sources import files
from chunklake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")


def _live(spark: SparkSession, d: str) -> DataFrame:
    return store.live_recipes(fx.recipe_log(spark, d)).select("content_id")


def _live_recipes(spark: SparkSession, d: str) -> DataFrame:
    return fx.recipes(spark, d).join(_live(spark, d), "content_id", "left_semi")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return chunking.contents_of(fx.table(spark, d, "documents"), "text", "doc_id")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(p,) for p in ("/", "/arquivos", "/arquivos/src1/en", "/none", "/.Trash-1000", "/notes", "/arquivos/empty")], "path string")
    return asked.union(fx.entries(spark, d).select("path")).distinct()


# --- reports


@query
def stats_overview(spark, d):
    return reports.stats(fx.entries(spark, d))


@query
def codebook_stats(spark, d):
    return reports.codebook_stats(fx.entries(spark, d), fx.codebooks(spark, d))


@query
def package_report(spark, d):
    return reports.package_report(fx.entries(spark, d))


@query
def store_stats(spark, d):
    return reports.store_stats(fx.chunk_index(spark, d), _live(spark, d), fx.frames(spark, d))


@query
def content_info(spark, d):
    return reports.content_info(fx.recipes(spark, d))


@query
def dup_contents(spark, d):
    return reports.duplicates(fx.entries(spark, d))


@query
def size_rollup(spark, d):
    return reports.rollup(fx.entries(spark, d))


@query
def bundle_meta(spark, d):
    return files.bundle_meta(fx.entries(spark, d))


@query
def bundle_members(spark, d):
    return files.bundle_members(fx.entries(spark, d))


# --- search and listings


@query
def match_term(spark, d):
    return search.match(fx.entries(spark, d), "doc_1").select("rank", "ord", "name")


@query
def match_package(spark, d):
    return search.match(fx.entries(spark, d), "SRC1").select("rank", "ord", "group")


@query
def grep_lines(spark, d):
    return search.grep(_texts(spark, d), "License", 300)


@query
def search_capped(spark, d):
    return search.search(_texts(spark, d), "the")


@query
def entries_in_folder(spark, d):
    return catalog.entries_in(fx.entries(spark, d), "/arquivos/src1", True).select("ord", "path")


@query
def sub_folders(spark, d):
    return catalog.sub_folders(fx.folders(spark, d), "/arquivos")


@query
def open_dir(spark, d):
    return catalog.open_dir(fx.folders(spark, d), fx.entries(spark, d), "/arquivos/src1")


@query
def lookup_path(spark, d):
    return catalog.lookup(_paths(spark, d), fx.folders(spark, d), fx.entries(spark, d))


@query
def path_stat(spark, d):
    return catalog.stat(_paths(spark, d), fx.folders(spark, d), fx.entries(spark, d))


@query
def folder_tree(spark, d):
    return catalog.folder_tree(fx.folders(spark, d))


@query
def entry_ancestors(spark, d):
    e = fx.entries(spark, d).select("size", F.explode(scalars.ancestors(F.col("folder"))).alias("path"))
    return fx.folders(spark, d).join(e, "path").groupBy("path").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query
def trash_folders(spark, d):
    return fx.folders(spark, d).select("path", scalars.is_trash(F.concat("path", F.lit("/"))).alias("is_trash"))


# --- scalar functions


@query
def human_sizes(spark, d):
    e = fx.entries(spark, d)
    return e.select("ord", scalars.human_size(F.col("size")).alias("size_text"), scalars.human_size(F.col("size") * F.col("size")).alias("large_text"))


@query
def canonical_paths(spark, d):
    e = fx.entries(spark, d)
    lang = F.split_part(F.col("rel_path"), F.lit("/"), F.lit(1))
    folder = F.when(F.col("ord") % 4 == 0, "/").when(F.col("ord") % 4 == 1, F.col("folder")).when(F.col("ord") % 4 == 2, F.concat("folder", F.lit("/"), lang)).otherwise(F.concat(F.lit("/"), lang))
    return e.select("ord", scalars.canonical_path(folder, F.col("rel_path")).alias("path"))


@query
def archive_paths(spark, d):
    e = fx.entries(spark, d).select("ord", F.when(F.col("ord") % 3 == 0, F.col("source_path")).otherwise(F.col("path")).alias("path"))
    return e.select("ord", scalars.archive_parts(F.col("path")).alias("p")).select("ord", "p.is_archive", "p.folder", "p.grp", "p.rel")


@query
def entry_forms(spark, d):
    e = reports.keyed(fx.entries(spark, d))
    return e.select(
        "ord", "content_key", scalars.codebook_name(F.col("codebook")).alias("codebook"), scalars.display_mode(F.col("mode")).cast("int").alias("mode"),
        scalars.entry_uid(F.col("path"), F.col("id")).alias("uid"), F.round(scalars.percent(F.col("stored_size"), F.col("size")), 6).alias("ratio"),
        scalars.is_content_id(F.col("id")).alias("is_id"), scalars.base_name(F.col("path")).alias("base"),
    )


@query
def hit_rates(spark, d):
    out = F.concat(F.lit("packed\n  Hit Rate: "), F.col("ord") % 100, F.lit("."), F.col("ord") % 10, F.lit("%\nHit Rate: 1"))
    return fx.entries(spark, d).select("ord", scalars.parse_hit_rate(F.when(F.col("ord") % 9 == 0, "none").otherwise(out)).alias("hit_rate"))


# --- catalog changes


@query
def rename_folder(spark, d):
    _, e = catalog.rename_folder(fx.folders(spark, d), fx.entries(spark, d), "/arquivos/src1", "/moved/one")
    return e.select("ord", "folder", "path")


@query
def renamed_folders(spark, d):
    f, _ = catalog.rename_folder(fx.folders(spark, d), fx.entries(spark, d), "/arquivos/src1", "/moved/one")
    return f


@query
def delete_folder(spark, d):
    _, e = catalog.delete_folder(fx.folders(spark, d), fx.entries(spark, d), "/arquivos/src2")
    return e.select("ord", "folder", "path")


@query
def move_entry(spark, d):
    return catalog.move_entry(fx.entries(spark, d), fx.folders(spark, d), "doc-5", "/notes").select("ord", "folder", "path")


@query
def rename_entry(spark, d):
    e = fx.entries(spark, d)
    old = e.filter("uid = 'doc-7'").first().path
    return catalog.rename_entry(e, old, "/arquivos/renamed/sub/new.txt").select("ord", "name", "folder", "path", "group")


@query
def rename_group(spark, d):
    _, e = catalog.rename_group(fx.folders(spark, d), fx.entries(spark, d), "src3", "renamed")
    return e.select("ord", "group", "path")


@query
def create_folder(spark, d):
    return catalog.create_folder(fx.folders(spark, d), "/deep//new/./folder/")


@query
def add_plan(spark, d):
    e = fx.entries(spark, d)
    new = e.filter("ord % 2 = 0").select("source_path", "group", "rel_path", "id").union(e.filter("ord % 2 = 1").select(F.concat(F.lit("/new"), "source_path"), "group", "rel_path", F.when(F.col("ord") % 3 == 0, F.sha2(F.col("uid"), 256)).otherwise(F.col("id"))))
    return catalog.add_entries(e.filter("ord % 4 <> 2"), new).select("source_path", "id", "status", "stored_size")


@query
def replace_paths(spark, d):
    e = fx.entries(spark, d).select("ord", "path", "size")
    new = e.filter("ord % 5 = 0").select((F.col("ord") + 1000000).alias("ord"), "path", (F.col("size") + 1).alias("size"))
    return catalog.replace_entries(e, new)


@query
def remove_release(spark, d):
    e = fx.entries(spark, d)
    _, gone = catalog.remove_entries(e, e.filter("ord % 4 = 0").select("uid"))
    return gone


@query
def remove_keep(spark, d):
    e = fx.entries(spark, d)
    kept, _ = catalog.remove_entries(e, e.filter("ord % 4 = 0").select("uid"))
    return kept.select("ord", "uid")


@query
def merge_manifest(spark, d):
    disk, local = fx.merge_sides(spark, d)
    return catalog.merge_entries(disk, local).select("uid", "name", "side", F.col("at").alias("place"))


@query
def merge_folders(spark, d):
    f = fx.folders(spark, d)
    n = F.length("path") % 3
    return catalog.merge_folders(f.filter(n != 0), f.filter(n != 1), f.filter(F.length("path") % 5 == 0), f.filter(F.length("path") % 2 == 0))


@query
def extract_plan(spark, d):
    e = fx.entries(spark, d)
    there = e.filter("ord % 6 = 0").select(F.concat(F.lit("/out/"), "group", F.lit("/"), "rel_path").alias("target"))
    return files.extract_plan(e, there, "/out/").select("ord", "target", F.col("mode").cast("int").alias("mode"), "status")


# --- logs and liveness


@query
def recipe_log_compaction(spark, d):
    return store.live_recipes(fx.recipe_log(spark, d)).select("content_id", F.col("op").cast("int").alias("op"), "log_pos")


@query
def recipe_log_health(spark, d):
    return store.log_health(fx.recipe_log(spark, d))


@query
def index_last_wins(spark, d):
    i = fx.chunk_index(spark, d).select("chunk_id", "seg", "frame_off", "log_pos")
    again = i.filter("log_pos % 3 = 0").select("chunk_id", (F.col("seg") + 8).cast("int").alias("seg"), "frame_off", (F.col("log_pos") + 300000000).alias("log_pos"))
    return store.newest(i.union(again), "chunk_id").select("chunk_id", "seg", "frame_off", "log_pos")


@query
def running_offsets(spark, d):
    return store.offsets(fx.recipes(spark, d)).select("content_id", "seq", "start", "len")


@query
def read_range(spark, d):
    sizes = fx.recipes(spark, d).groupBy("content_id").agg(F.sum("len").alias("size"))
    ranges = sizes.select("content_id", F.floor(F.col("size") / 3).cast("long").alias("off"), F.lit(2500).cast("long").alias("n"))
    return store.blocks_of_range(fx.recipes(spark, d), ranges).select("content_id", "seq", "skip", "take")


@query
def mark_live(spark, d):
    return store.mark_live(fx.chunk_index(spark, d), _live_recipes(spark, d))


@query
def garbage(spark, d):
    i = fx.chunk_index(spark, d)
    return store.garbage(i, store.mark_live(i, _live_recipes(spark, d)))


@query
def orphan_bases(spark, d):
    return store.orphan_bases(fx.chunk_index(spark, d), _live_recipes(spark, d))


@query
def delta_bases(spark, d):
    i = fx.chunk_index(spark, d)
    base = i.select(F.col("chunk_id").alias("base_id"), F.col("size").alias("base_size"), F.col("is_delta").alias("base_is_delta"))
    return i.filter("is_delta").join(base, "base_id").select("chunk_id", "base_id", "base_size", "base_is_delta")


@query
def frame_usage(spark, d):
    i = fx.chunk_index(spark, d)
    return store.frame_usage(fx.frames(spark, d), i, store.mark_live(i, _live_recipes(spark, d)))


@query
def gc_segments(spark, d):
    i = fx.chunk_index(spark, d)
    return store.gc_segments(store.frame_usage(fx.frames(spark, d), i, store.mark_live(i, _live_recipes(spark, d))), 0.3)


@query
def gc_plan(spark, d):
    return store.gc_plan(fx.chunk_index(spark, d), fx.frames(spark, d), _live_recipes(spark, d), 0.3)


@query
def segment_budget(spark, d):
    return store.segment_budget(fx.frames(spark, d), 300_000)


@query
def segment_list(spark, d):
    return fx.frames(spark, d).select("seg").distinct().orderBy("seg")


@query
def frame_headers(spark, d):
    return fx.frames(spark, d).select("seg", "frame_off", "codec", "raw_len")


@query
def newest_bases(spark, d):
    return similarity.newest_bases(fx.features(spark, d))


@query
def delta_candidates(spark, d):
    f = fx.features(spark, d)
    return similarity.candidates(f, f)


@query
def usable_candidates(spark, d):
    f, i = fx.features(spark, d), fx.chunk_index(spark, d)
    return similarity.candidates(f, f, i.filter("not is_delta").join(store.mark_live(i, _live_recipes(spark, d)), "chunk_id", "left_semi").select("chunk_id"))


@query
def compacted_features(spark, d):
    return store.compact_features(fx.features(spark, d), fx.chunk_index(spark, d), force=True).select("chunk_id", "slot", "f")


@query
def one_block_contents(spark, d):
    n = fx.recipes(spark, d).groupBy("content_id").agg(F.count("*").alias("n"))
    return n.select("content_id", (F.col("n") == 1).alias("one_block"), scalars.recipe_bytes(F.col("n"), F.col("n") == 1).cast("long").alias("record_bytes"))


@query
def dangling_entries(spark, d):
    return store.dangling_entries(fx.entries(spark, d), _live(spark, d)).select("ord", "id")


@query
def orphan_files(spark, d):
    return store.orphan_files(fx.pack_files(spark, d), fx.entries(spark, d))


@query
def missing_codebooks(spark, d):
    return store.missing_codebooks(fx.entries(spark, d), fx.codebooks(spark, d)).select("ord", "book")


@query
def dup_uids(spark, d):
    e = fx.entries(spark, d).select("uid")
    return store.duplicate_uids(e.union(fx.entries(spark, d).filter("ord % 13 = 0").select("uid")))


@query
def doctor(spark, d):
    return store.doctor(fx.entries(spark, d), fx.recipe_log(spark, d), fx.chunk_index(spark, d), fx.recipes(spark, d), fx.pack_files(spark, d), fx.codebooks(spark, d))


@query
def recipe_sums(spark, d):
    c = fx.contents(spark, d).select("content_id", (F.octet_length("text") + F.when(F.col("ord") % 17 == 0, 1).otherwise(0)).cast("long").alias("size"))
    return store.recipe_sums(fx.recipes(spark, d), c).select("content_id", "size")


@query
def contents_list(spark, d):
    return _live(spark, d)


@query
def entry_by_id(spark, d):
    e = fx.entries(spark, d)
    return e.groupBy("id").agg(F.min("ord").alias("ord"), F.min_by("uid", "ord").alias("uid"))


@query
def reference_counts(spark, d):
    return store.reference_counts(fx.entries(spark, d))


@query
def optimize_candidates(spark, d):
    f = fx.features(spark, d).filter("log_pos % 4 = 0")
    return store.optimize_candidates(fx.chunk_index(spark, d), f, _live_recipes(spark, d)).select("chunk_id", "size")


@query
def position_order(spark, d):
    i = fx.chunk_index(spark, d)
    return store.positions(i.withColumn("off_in_frame", F.lit(0))).select("seg", "frame_off", "chunk_id")


@query
def stale_spool(spark, d):
    pending = fx.entries(spark, d).select("path", F.col("packed_at").alias("modified"))
    return store.expired(pending, "2024-01-02 10:00:00").select("path")


@query
def codebook_list(spark, d):
    return fx.codebooks(spark, d).orderBy("name")


@query
def manifest_json(spark, d):
    e = fx.entries(spark, d)
    return e.select("ord", F.to_json(F.struct("uid", "id", "name", "size")).alias("line"))


@query
def clean_folders(spark, d):
    f = fx.folders(spark, d)
    return catalog.clean_folders(f.filter("path <> '/'").union(spark.createDataFrame([("",), ("/notes",)], "path string")))


@query
def saved_by_delta(spark, d):
    i = fx.chunk_index(spark, d)
    orphans = store.orphan_bases(i, _live_recipes(spark, d))
    replacements = i.filter("is_delta").select("base_id", (F.floor(F.col("size") / 2) + 40).cast("long").alias("len"))
    return store.rebase_worth(orphans, replacements).select("base_id", "keep", "change", "apply")


@query
def approx_uniques(spark, d):
    return store.approx_uniques(fx.recipes(spark, d))


@query
def segment_roll(spark, d):
    f = fx.frames(spark, d).select((F.col("seg") % 4).alias("writer"), (F.col("seg") * 1000 + F.floor(F.col("frame_off") / 1048576)).cast("int").alias("frame"), F.col("comp_len").alias("disk"))
    return store.roll_segments(f, 100_000)


# --- byte kernels; most have no SQL and are tested against scalar versions and round trips


@query
def piece_dedup(spark, d):
    r = fx.recipes(spark, d)
    return chunking.put_results(fx.contents(spark, d), r).select("content_id", "chunks", "size", "new_chunks", "new_bytes", "hit_rate")


@query
def chunk_documents(spark, d):
    return chunking.chunk(_raw(spark, d)).select("content_id", "seq", "chunk_id", "start", "len")


@query
def chunk_dedup(spark, d):
    raw = _raw(spark, d)
    return chunking.put_results(raw, chunking.chunk(raw))


@query
def roundtrip_sha(spark, d):
    blocks = chunking.chunk(_raw(spark, d), payload=True)
    payloads = chunking.new_chunks(blocks).select("chunk_id", "payload")
    return chunking.reconstruct(blocks, payloads).select("content_id", "ok", F.octet_length("content").cast("long").alias("size"))


@query
def bundle_errors(spark, d):
    """Members of all packages against rebuilt contents of which some have another byte and some are lost."""
    raw = _raw(spark, d)
    bad = raw.filter("ord % 13 <> 1").select("content_id", F.when(F.col("ord") % 13 == 2, F.concat("content", F.lit(b"x").cast("binary"))).otherwise(F.col("content")).alias("content"))
    return files.bundle_errors(files.bundle_members(fx.entries(spark, d)).select("name", "sha256").distinct(), bad)


@query
def near_blocks(spark, d):
    blocks = chunking.new_chunks(chunking.chunk(_raw(spark, d), payload=True)).select("chunk_id", "payload")
    return similarity.set_candidates(similarity.features(blocks))


@query
def delta_encode(spark, d):
    blocks = chunking.new_chunks(chunking.chunk(_raw(spark, d), payload=True)).select("chunk_id", "payload")
    deltas = similarity.encode(similarity.set_candidates(similarity.features(blocks)), blocks)
    return deltas.select("chunk_id", "base_id", "size", F.octet_length("delta").cast("long").alias("delta_size"))


def _packed(spark, d):
    blocks = chunking.new_chunks(chunking.chunk(_raw(spark, d))).withColumn("writer", F.pmod(F.xxhash64("content_id"), F.lit(16)).cast("int"))
    return chunking.pack_frames(blocks, 1 << 20)


@query
def frame_pack(spark, d):
    return _packed(spark, d)


@query
def recompress(spark, d):
    payloads = chunking.new_chunks(chunking.chunk(_raw(spark, d), payload=True)).select("chunk_id", "payload")
    frames = codec.build_frames(_packed(spark, d), payloads).withColumnRenamed("writer", "seg")
    out = codec.recompress(frames, frames.select("seg").distinct())
    return out.select("seg", "frame", "raw_len", "codec", F.octet_length("data").cast("long").alias("comp_len"))


@query
def codec_bench(spark, d):
    return codec.codec_bench(_raw(spark, d))


# --- time


@query
def idle_sessions(spark, d):
    e = fx.table(spark, d, "events")
    return jobs.idle_periods_by(e, "user_id", 600).select("user_id", "start", "last", "events")


@query
def may_work(spark, d):
    """Whether maintenance may run after each event, by metrics made of its numbers."""
    e = fx.table(spark, d, "events")
    quiet, load, free = (F.col("event_id") * 37 % 1200).alias("idle_seconds"), (F.col("event_id") % 40 / 10).alias("load1"), (F.col("event_id") * 11 % 2000).alias("free_mb")
    m = e.select("event_id", quiet, load, free, (F.col("event_id") % 9 == 0).alias("open_batch"))
    return m.select("event_id", jobs.may_work(m, 8).alias("may_work"))


@query
def activity_sessions(spark, d):
    return jobs.idle_periods(fx.table(spark, d, "events"), "10 minutes")


@query
def events_tumbling(spark, d):
    return jobs.windows(fx.table(spark, d, "events"))
