"""A deduplicated content lake: the operators over versioned tables, as one object.

Tables: entries (schema.ENTRY), folders (path), codebooks (name, size, is_default), recipes
(content_id, seq, chunk_id, len), blocks (chunk_id, size, codec, base_id, data) and features
(chunk_id, slot, f, log_pos). A block is whole (base_id null; codec 0 raw, 1 compressed, 2 compressed
at the highest level) or a delta on a whole block. Every change publishes one new version; whatever
fails before that stays invisible. There is one writer; readers pin a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake import schema
from chunklake.functions import kernels, scalars
from chunklake.operators import catalog, chunking, codec, reports, search, similarity, store
from chunklake.sources import files
from chunklake.sources.snapshot import Snapshots

_EMPTY = {
    "folders": "path string",
    "codebooks": "name string, size long, is_default boolean",
    "recipes": "content_id string, seq int, chunk_id string, len long",
    "blocks": "chunk_id string, size long, codec int, base_id string, data binary",
    "features": "chunk_id string, slot int, f long, log_pos long",
}


#: Blocks that a read names in the scan's filter, at most.
FEW = 1_000


def by_block(blocks: DataFrame) -> DataFrame:
    """``blocks`` dealt and sorted by their names, for the statistics of the files."""
    return blocks.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` with ``ord``: first, first + 1, ... by rel_path and id. Only a count for each partition comes to the driver."""
    ranged = rows.repartitionByRange("rel_path", "id").sortWithinPartitions("rel_path", "id")
    ranged = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist()
    starts, at = [], first
    for r in ranged.groupBy("_p").count().orderBy("_p").collect():
        starts.append((r["_p"], at))
        at += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_p int, _start long")
    return ranged.join(F.broadcast(starts), "_p").withColumn("ord", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


class Lake:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.snapshots = spark, Snapshots(spark, root)

    def init(self) -> None:
        """Version 1: an empty catalog with the folder "/"."""
        empty = {name: self.spark.createDataFrame([], kind) for name, kind in _EMPTY.items()}
        top = self.spark.createDataFrame([("/",)], "path string")
        self.snapshots.publish(empty | {"entries": self.spark.createDataFrame([], schema.ENTRY), "folders": top})

    def _read(self, name: str) -> DataFrame:
        return self.snapshots.read(name)

    # --- queries

    def entries(self, folder: str = "/", recursive: bool = True) -> DataFrame:
        return catalog.entries_in(self._read("entries"), folder, recursive)

    def tree(self) -> DataFrame:
        return catalog.folder_tree(self._read("folders"))

    def stats(self) -> DataFrame:
        return reports.stats(self._read("entries"))

    def codebook_stats(self) -> DataFrame:
        return reports.codebook_stats(self._read("entries"), self._read("codebooks"))

    def package_report(self) -> DataFrame:
        return reports.package_report(self._read("entries"))

    def match(self, term: str) -> DataFrame:
        return search.match(self._read("entries"), term)

    def info(self) -> DataFrame:
        return reports.content_info(self._read("recipes"))

    def contents(self, ids: DataFrame | None = None) -> DataFrame:
        """(content_id, content, ok) of all stored contents, or of those in ``ids`` (content_id); only their blocks are read."""
        recipes = self._read("recipes")
        if ids is not None:
            recipes = recipes.join(ids, "content_id", "left_semi")
        return chunking.reconstruct(recipes, self.payloads(recipes.select("chunk_id").distinct()))

    def payloads(self, chunks: DataFrame | None = None, few: bool = False) -> DataFrame:
        """(chunk_id, payload) of blocks, decoded; deltas through their bases.

        With ``few``, up to FEW wanted blocks and their bases are named in the scan's filter. Files
        are sorted by block, so their statistics leave out nearly all row groups.
        """
        every = self._read("blocks")
        if few and chunks is not None:
            names = [r.chunk_id for r in chunks.limit(FEW + 1).collect()]
            if len(names) <= FEW:
                bases = [r.base_id for r in every.filter(F.col("chunk_id").isin(names) & F.col("base_id").isNotNull()).select("base_id").distinct().collect()]
                every = every.filter(F.col("chunk_id").isin([*names, *bases]))
        wanted = every if chunks is None else every.join(chunks, "chunk_id", "left_semi")
        deltas = wanted.filter("base_id is not null")
        needed = wanted.filter("base_id is null").select("chunk_id").union(deltas.select("base_id")).distinct()
        whole = every.filter("base_id is null").join(needed, "chunk_id", "left_semi").select("chunk_id", codec.unframe(F.when(F.col("codec") > 0, 1).otherwise(0), "data", "size").alias("payload"))
        decoded = similarity.decode(deltas.select("chunk_id", "base_id", "size", F.col("data").alias("delta")), whole)
        out = whole.union(decoded)
        return out if chunks is None else out.join(chunks, "chunk_id", "left_semi")

    def read(self, ranges: DataFrame) -> DataFrame:
        """(content_id, content) of byte ranges (content_id, off, n)."""
        blocks = store.blocks_of_range(self._read("recipes"), ranges)
        return chunking.read_ranges(blocks, self.payloads(blocks.select("chunk_id").distinct(), few=True))

    def verify(self) -> DataFrame:
        """Contents that can't be rebuilt with their own hash."""
        return self.contents().filter("not ok").select("content_id")

    def garbage(self) -> DataFrame:
        index = self._index()
        return store.garbage(index, store.mark_live(index, self._read("recipes")))

    def _index(self) -> DataFrame:
        return self._read("blocks").select("chunk_id", "size", F.col("base_id").isNotNull().alias("is_delta"), "base_id")

    # --- changes

    def add(self, new: DataFrame, group: str, codebook: str = "") -> DataFrame:
        """Store files (rel_path, content) as a package and return their entries.

        Contents and blocks that are there already cost nothing; new blocks of 1 KiB or more become
        deltas where a near block pays. A file at the path of another entry takes its place. Entries are
        numbered by path. ``new`` may have a ``mode``; else it is 0644. Paths that leave the package's
        folder are an error.
        """
        if not new.filter(files.is_outside(F.col("rel_path")) | files.is_outside(F.lit(group))).isEmpty():
            raise ValueError("a path leaves the package's folder")
        folder = f"/arquivos/{group}"
        known, old, index = self._read("entries"), self._read("recipes"), self._index()
        first = known.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
        mode = F.coalesce(F.col("mode").cast("long"), F.lit(0o644)) if "mode" in new.columns else F.lit(0o644).cast("long")
        rows = new.select("rel_path", F.col("content").cast("binary").alias("content"), mode.alias("mode")).withColumn("id", F.sha2("content", 256)).persist()
        try:
            raw = rows.groupBy(F.col("id").alias("content_id")).agg(F.any_value("content").alias("content"), F.min(F.xxhash64("rel_path")).alias("ord"))
            raw = raw.join(old.select("content_id"), "content_id", "left_anti")
            chunks = chunking.chunk(raw, payload=True).persist()
            blocks = chunking.new_chunks(chunks, index).select("chunk_id", "payload").persist()
            probes = similarity.features(blocks).persist()
            against = similarity.candidates(probes, self._read("features"), index.filter("not is_delta").select("chunk_id"))
            stored = self.payloads(against.select(F.col("base_id").alias("chunk_id")).distinct())
            within = similarity.set_candidates(probes.join(against, "chunk_id", "left_anti"))
            deltas = similarity.encode(against, blocks.union(stored)).union(similarity.encode(within, blocks)).persist()
            whole = blocks.join(deltas.select("chunk_id"), "chunk_id", "left_anti")
            form = codec.frame_form("payload")
            size = F.octet_length("payload").cast("long")
            framed = whole.select("chunk_id", size.alias("size"), form.alias("f")).select("chunk_id", "size", "f.codec", F.lit(None).cast("string").alias("base_id"), F.col("f.data").alias("data"))
            packed = framed.union(deltas.select("chunk_id", "size", F.lit(0), "base_id", F.col("delta").alias("data"))).persist()
            bases = probes.join(whole.select("chunk_id"), "chunk_id", "left_semi").withColumn("log_pos", F.lit(len(self.snapshots.versions())).cast("long"))
            # A content is charged for the blocks that it stored first.
            owner = chunking.new_chunks(chunks, index).select("chunk_id", "content_id")
            cost = packed.select("chunk_id", F.octet_length("data").alias("n")).join(owner, "chunk_id").groupBy(F.col("content_id").alias("id")).agg(F.sum("n").alias("stored"))
            form = known.groupBy("id").agg(F.min_by("stored_size", "ord").alias("was"))
            path = F.concat(F.lit(folder + "/"), "rel_path")
            hits = chunking.put_results(raw, chunks.drop("payload"), index).select(F.col("content_id").alias("id"), "hit_rate")
            added = _numbered(rows.select("rel_path", "id", "mode", F.octet_length("content").cast("long").alias("size")), first)
            added = added.join(cost, "id", "left").join(form, "id", "left").join(hits, "id", "left")
            already = F.when(F.col("size") > 0, 100.0).otherwise(0.0)  # all blocks of a stored content are there
            made = added.select(
                "ord", scalars.entry_uid(path, F.col("id")).alias("uid"), "id", scalars.base_name(F.col("rel_path")).alias("name"),
                F.lit(group).alias("group"), "rel_path", F.lit(folder).alias("folder"), path.alias("path"), F.lit(True).alias("is_dir"), F.lit("").alias("source_path"), "size",
                F.lit("").alias("pack_file"), F.coalesce("was", "stored", F.lit(0)).cast("long").alias("stored_size"), F.lit(schema.BLOCKS).alias("storage"), F.lit(codebook).alias("codebook"),
                F.coalesce("hit_rate", already).alias("hit_rate"), "mode", F.lit(None).cast("array<string>").alias("pack_flags"), F.current_timestamp().alias("packed_at"), F.lit(True).alias("verified"),
            )
            places = self._read("folders").union(self.spark.createDataFrame([(folder,)], "path string")).select(F.explode(scalars.ancestors(F.col("path"))).alias("path")).distinct()
            entries = catalog.replace_entries(known, made)
            self.snapshots.publish({"entries": entries, "folders": places}, {"blocks": by_block(packed), "recipes": chunks.select("content_id", "seq", "chunk_id", "len"), "features": bases})
        finally:
            self.spark.catalog.clearCache()
        return self._read("entries").filter(F.col("group") == group)

    def remove(self, uids: DataFrame) -> None:
        """Entries go, and the recipes of contents that no entry names any more; their blocks stay until gc()."""
        kept, _ = catalog.remove_entries(self._read("entries"), uids)
        recipes = self._read("recipes").join(kept.select(F.col("id").alias("content_id")), "content_id", "left_semi")
        self.snapshots.publish({"entries": kept, "recipes": recipes})

    def gc(self, least_share: float = 0.0) -> int:
        """Blocks that nothing needs go, with their features; bases of dead deltas stay for one more round. Bytes that went.

        Only folders of blocks in which more than ``least_share`` of the bytes is dead are written anew,
        without them; the others stay as they are. Nothing is published if there are none. The old
        folders go with vacuum(). Refused while a stored content has a damaged recipe: what it needs
        isn't known.
        """
        index = self._index()
        stored = self._read("entries").filter(F.col("storage") == schema.BLOCKS).select(F.col("id").alias("content_id"), "size")
        if (bad := store.damaged_recipes(stored, self._read("recipes"), index).limit(3).collect()) != []:
            raise catalog.CatalogError(f"damaged recipes, so nothing is deleted: {', '.join(r.content_id for r in bad)} …")
        live = store.mark_live(index, self._read("recipes")).persist()
        try:
            placed = self.snapshots.by_folder("blocks").select("chunk_id", "folder", F.octet_length("data").cast("long").alias("n"))
            dead = placed.join(live.withColumn("live", F.lit(True)), "chunk_id", "left").groupBy("folder").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("live").isNull(), F.col("n"))).alias("dead"))
            worth = {r.folder: r.dead for r in dead.filter(F.col("dead") > F.col("n") * least_share).collect()}  # a row for each change
            if not worth:
                return 0
            old = self.spark.read.parquet(*(f"{self.snapshots.root}/{folder}" for folder in worth))
            gone = old.join(live, "chunk_id", "left_anti").select("chunk_id")
            blocks = old.join(live, "chunk_id", "left_semi")
            features = self._read("features").join(gone, "chunk_id", "left_anti")
            left = index.join(gone, "chunk_id", "left_anti").select("chunk_id", "is_delta")
            features = store.compact_features(features, left, force=True)
            kept = [folder for folder in self.snapshots.tables()["blocks"] if folder not in worth]
            self.snapshots.publish({"blocks": by_block(blocks), "features": features}, kept={"blocks": kept})
            return sum(worth.values())
        finally:
            live.unpersist()

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete old versions and the files that only they need; how many folders went."""
        return self.snapshots.vacuum(keep_versions)

    def rebase(self) -> None:
        """Bases that only deltas need are given up where that pays: their deltas move to other bases, or become whole.

        The blocks of the bases themselves go at the next gc().
        """
        blocks, used = self._read("blocks"), self._read("recipes").select("chunk_id").distinct()
        sized = blocks.select("chunk_id", F.octet_length("data").cast("long").alias("size"), F.col("base_id").isNotNull().alias("is_delta"), "base_id")
        orphans = store.orphan_bases(sized, used).persist()
        try:
            old = blocks.join(orphans.select("base_id"), "base_id", "left_semi").join(used, "chunk_id", "left_semi").select("chunk_id", F.col("base_id").alias("old"))
            own = self.payloads(old.select("chunk_id")).persist()
            usable = sized.filter("not is_delta").join(used, "chunk_id", "left_semi").join(orphans.select(F.col("base_id").alias("chunk_id")), "chunk_id", "left_anti")
            probes = similarity.features(own)
            pairs = similarity.candidates(probes, self._read("features"), usable.select("chunk_id"))
            moved = similarity.encode(pairs, own.union(self.payloads(pairs.select(F.col("base_id").alias("chunk_id")).distinct()))).select("chunk_id", "base_id", "delta")
            whole = own.select("chunk_id", F.octet_length("payload").cast("long").alias("size"), codec.frame_form("payload").alias("f"))
            is_moved = F.col("delta").isNotNull()
            new = whole.join(moved, "chunk_id", "left").join(old, "chunk_id").select("chunk_id", "size", F.when(is_moved, 0).otherwise(F.col("f.codec")).alias("codec"), "base_id", F.coalesce("delta", "f.data").alias("data"), "old")
            cost = new.select(F.col("old").alias("base_id"), (F.octet_length("data") + F.when(F.col("base_id").isNotNull(), 32).otherwise(0)).alias("len"))
            worth = store.rebase_worth(orphans, cost).filter("apply").select(F.col("base_id").alias("old"))
            done = new.join(worth, "old", "left_semi").drop("old").persist()
            fresh = probes.join(done.filter("base_id is null").select("chunk_id"), "chunk_id", "left_semi").withColumn("log_pos", F.lit(len(self.snapshots.versions())).cast("long"))
            self.snapshots.publish({"blocks": blocks.join(done.select("chunk_id"), "chunk_id", "left_anti").unionByName(done)}, {"features": fresh})
        finally:
            self.spark.catalog.clearCache()

    def recompress(self) -> None:
        """Whole blocks compressed at the highest level where that gains; a second run finds nothing to do."""
        blocks = self._read("blocks")
        todo = blocks.filter("base_id is null and codec = 1").select("chunk_id", F.lit(0).alias("seg"), "codec", F.col("size").alias("raw_len"), "data")
        done = codec.recompress(todo, self.spark.createDataFrame([(0,)], "seg int")).select("chunk_id", F.col("raw_len").alias("size"), "codec", F.lit(None).cast("string").alias("base_id"), "data")
        self.snapshots.publish({"blocks": blocks.filter("base_id is not null or codec <> 1").union(done)})

    def optimize(self) -> None:
        """Whole blocks that aren't bases become deltas on older near ones where that pays."""
        blocks = self._read("blocks")
        whole = blocks.filter(F.col("base_id").isNull() & (F.col("size") >= kernels.DELTA_LEAST))
        bases = blocks.filter("base_id is not null").select(F.col("base_id").alias("chunk_id")).distinct()
        payloads = self.payloads(whole.select("chunk_id")).persist()
        try:
            pairs = similarity.set_candidates(similarity.features(payloads)).join(bases, "chunk_id", "left_anti")
            deltas = similarity.encode(pairs, payloads).select("chunk_id", "size", F.lit(0).alias("codec"), "base_id", F.col("delta").alias("data"))
            old = blocks.select("chunk_id", F.octet_length("data").alias("n"))
            better = deltas.join(old, "chunk_id").filter(F.octet_length("data") + 32 < F.col("n")).drop("n").persist()
            kept = blocks.join(better.select("chunk_id"), "chunk_id", "left_anti")
            features = self._read("features").join(better.select("chunk_id"), "chunk_id", "left_anti")
            self.snapshots.publish({"blocks": kept.unionByName(better), "features": features})
        finally:
            self.spark.catalog.clearCache()

    def create_folder(self, path: str) -> None:
        self.snapshots.publish({"folders": catalog.create_folder(self._read("folders"), path)})

    def rename_folder(self, old: str, new: str) -> None:
        folders, entries = catalog.rename_folder(self._read("folders"), self._read("entries"), old, new)
        self.snapshots.publish({"folders": folders, "entries": entries})

    def delete_folder(self, path: str) -> None:
        folders, entries = catalog.delete_folder(self._read("folders"), self._read("entries"), path)
        self.snapshots.publish({"folders": folders, "entries": entries})

    def move_entry(self, uid: str, target: str) -> None:
        self.snapshots.publish({"entries": catalog.move_entry(self._read("entries"), self._read("folders"), uid, target)})

    def export_group(self, group: str, path: str) -> None:
        recipes = self._read("recipes")
        own = self._read("entries").filter(F.col("group") == group).select(F.col("id").alias("content_id")).distinct()
        chunks = recipes.join(own, "content_id", "left_semi")
        payloads = self.payloads(chunks.select("chunk_id").distinct())
        files.export_group(self._read("entries"), chunks.join(payloads, "chunk_id"), group, path)

    def import_group(self, path: str, group: str) -> DataFrame:
        """Add a package from export_group(), under a name."""
        members, blocks = files.open_bundle(self.spark, path)
        if not members.filter(files.is_outside(F.col("rel_path"))).isEmpty():
            raise ValueError("the package has paths that leave its folder")
        whole = chunking.reconstruct(blocks, chunking.new_chunks(blocks.withColumn("ord", F.lit(0))).select("chunk_id", "payload"))
        check = members.select(F.col("rel_path").alias("name"), F.col("id").alias("sha256"), "size").filter("size > 0").drop("size")
        if not files.bundle_errors(check, whole).isEmpty():
            raise ValueError("the package is damaged")
        content = whole.select(F.col("content_id").alias("id"), "content")
        new = members.join(content, "id", "left").select("rel_path", F.coalesce("content", F.lit(b"").cast("binary")).alias("content"))
        return self.add(new, group)

    # --- codebooks

    def add_codebook(self, name: str, size: int) -> None:
        books = self._read("codebooks").filter(F.col("name") != name)
        is_first = books.isEmpty()
        self.snapshots.publish({"codebooks": books.union(self.spark.createDataFrame([(name, size, is_first)], _EMPTY["codebooks"]))})

    def use_codebook(self, name: str) -> None:
        books = self._read("codebooks")
        if books.filter(F.col("name") == name).isEmpty():
            raise catalog.CatalogError(f"no such codebook: {name}")
        self.snapshots.publish({"codebooks": books.withColumn("is_default", F.col("name") == name)})

    def remove_codebook(self, name: str) -> None:
        """Refused for the default, and while an entry names it."""
        books = self._read("codebooks")
        used = self._read("entries").filter(scalars.codebook_name(F.col("codebook")) == name)
        if not books.filter((F.col("name") == name) & F.col("is_default")).isEmpty() or not used.isEmpty():
            raise catalog.CatalogError(f"codebook in use: {name}")
        self.snapshots.publish({"codebooks": books.filter(F.col("name") != name)})
