"""Folders and entries: listings, and changes as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.functions import scalars


class CatalogError(ValueError):
    """A change that the catalog refuses."""


def entries_in(entries: DataFrame, folder: str, recursive: bool = False) -> DataFrame:
    here = F.col("folder") == folder
    return entries.filter(here | scalars.below(F.col("folder"), F.lit(folder)) if recursive else here)


def sub_folders(folders: DataFrame, folder: str) -> DataFrame:
    """Names of the direct children of ``folder`` among ``folders``, those only implied by deeper ones included."""
    prefix = folder.rstrip("/") + "/"
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    found = folders.filter(F.startswith("path", F.lit(prefix)) & (F.col("path") != prefix))
    return found.select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name")).filter("name <> ''").distinct().orderBy("name")


def open_dir(folders: DataFrame, entries: DataFrame, folder: str) -> DataFrame:
    """(kind, name): child folders, those implied by entry paths too, then files that no folder hides; no trash."""
    prefix = folder.rstrip("/") + "/"
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    paths = entries.select("path").filter(F.startswith("path", F.lit(prefix)))
    implied = paths.filter(F.contains(rest, F.lit("/"))).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"))
    shown = folders.filter(~scalars.is_trash(F.concat(F.col("path"), F.lit("/"))))
    dirs = sub_folders(shown, folder).union(implied).distinct()
    files = paths.filter(~F.contains(rest, F.lit("/"))).select(rest.alias("name")).distinct().join(dirs, "name", "left_anti")
    return dirs.select(F.lit("dir").alias("kind"), "name").union(files.select(F.lit("file").alias("kind"), "name")).orderBy("kind", "name")


def lookup(paths: DataFrame, folders: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, kind) of each asked path: dir, file or none. A folder is known, or implied by what lies below it."""
    known = folders.select("path", F.lit(True).alias("is_folder")).distinct()
    files = entries.select("path", F.lit(True).alias("is_file")).distinct()
    implied = entries.select(F.explode(scalars.ancestors(scalars.parent_of(F.col("path")))).alias("path")).distinct().select("path", F.lit(True).alias("is_implied"))
    out = paths.join(known, "path", "left").join(files, "path", "left").join(implied, "path", "left")
    kind = (
        F.when(F.col("path") == "/", "dir")
        .when(scalars.is_trash(F.concat("path", F.lit("/"))), "none")
        .when(F.col("is_folder"), "dir")
        .when(F.col("is_file"), "file")
        .when(F.col("is_implied"), "dir")
        .otherwise("none")
    )
    return out.select("path", kind.alias("kind"))


def folder_tree(folders: DataFrame) -> DataFrame:
    """(path, parent, name, depth) of each folder and of all above it."""
    deep = folders.select(F.explode(scalars.ancestors(F.col("path"))).alias("path")).distinct()
    top = F.col("path") == "/"
    depth = F.when(top, 0).otherwise(F.size(F.split("path", "/")) - 1)
    return deep.select("path", F.when(top, "").otherwise(scalars.parent_of(F.col("path"))).alias("parent"), F.when(top, "").otherwise(scalars.base_name(F.col("path"))).alias("name"), depth.alias("depth"))


def clean_folders(folders: DataFrame) -> DataFrame:
    """Distinct folders with "/" always there; '' means "/"."""
    top = folders.sparkSession.createDataFrame([("/",)], "path string")
    return folders.select(F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path")).union(top).distinct().orderBy("path")


def create_folder(folders: DataFrame, path: str) -> DataFrame:
    one = folders.sparkSession.createDataFrame([(path,)], "path string").select(scalars.normal_folder(F.col("path")).alias("path"))
    if not folders.join(one, "path", "left_semi").isEmpty():
        raise CatalogError(f"folder exists: {path}")
    return clean_folders(folders.select("path").union(one.select(F.explode(scalars.ancestors(F.col("path"))).alias("path"))))


def _moved(column: str, old: str, new: str):
    """``column`` with the folder ``old`` at its start replaced."""
    tail = F.substring(F.col(column), F.lit(len(old) + 1), F.length(column))
    under = (F.col(column) == old) | F.startswith(column, F.lit(old + "/"))
    return F.when(under, F.concat(F.lit(new), tail)).otherwise(F.col(column))


def rename_folder(folders: DataFrame, entries: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with every path at or below ``old`` moved to ``new``."""
    moved = folders.select(_moved("path", old, new).alias("path")).distinct()
    return moved, entries.withColumns({"folder": _moved("folder", old, new), "path": _moved("path", old, new)})


def delete_folder(folders: DataFrame, entries: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without ``folder``, whose entries move up to its parent under their base names; refused while it has subfolders."""
    if not sub_folders(folders, folder).isEmpty():
        raise CatalogError(f"folder has subfolders: {folder}")
    parent = folder.rsplit("/", 1)[0] or "/"
    here = F.col("folder") == folder
    up = F.concat(F.lit(parent.rstrip("/") + "/"), scalars.base_name(F.col("path")))
    return folders.filter(F.col("path") != folder), entries.withColumns({"path": F.when(here, up).otherwise(F.col("path")), "folder": F.when(here, F.lit(parent)).otherwise(F.col("folder"))})


def move_entry(entries: DataFrame, folders: DataFrame, uid: str, target: str) -> DataFrame:
    """``entries`` with one moved to ``target``, a known folder; what its path has below its old folder is kept."""
    if target != "/" and folders.filter(F.col("path") == target).isEmpty():
        raise CatalogError(f"no such folder: {target}")
    old = F.regexp_replace("folder", "/+$", "")
    suffix = F.when(scalars.below(F.col("path"), F.col("folder")), F.substring(F.col("path"), F.length(old) + 1, F.length("path"))).otherwise(F.concat(F.lit("/"), scalars.base_name(F.col("path"))))
    this = F.col("uid") == uid
    return entries.withColumns({"path": F.when(this, F.concat(F.lit(target.rstrip("/")), suffix)).otherwise(F.col("path")), "folder": F.when(this, F.lit(target)).otherwise(F.col("folder"))})


def rename_entry(entries: DataFrame, old: str, new: str, top: str = "/arquivos") -> DataFrame:
    """``entries`` with the one at path ``old`` at ``new``; its package follows from the new path."""
    found = {r.path for r in entries.filter(F.col("path").isin(old, new)).select("path").distinct().collect()}
    if old not in found:
        raise CatalogError(f"no such entry: {old}")
    if new in found:
        raise CatalogError(f"entry exists: {new}")
    parts = scalars.archive_parts(F.lit(new), top)
    this = F.col("path") == old
    put = {"name": F.lit(new.rsplit("/", 1)[1]), "folder": F.when(parts["is_archive"], parts["folder"]).otherwise(F.lit(new.rsplit("/", 1)[0] or "/")), "group": parts["grp"], "is_dir": parts["is_archive"], "path": F.lit(new)}
    return entries.withColumns({k: F.when(this, v).otherwise(F.col(k)) for k, v in put.items()})


def rename_group(folders: DataFrame, entries: DataFrame, old: str, new: str, top: str = "/arquivos") -> tuple[DataFrame, DataFrame]:
    """Both tables with a package under another name."""
    folders, entries = rename_folder(folders, entries, f"{top}/{old}", f"{top}/{new}")
    return folders, entries.withColumn("group", F.when(F.col("group") == old, new).otherwise(F.col("group")))


def add_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """What adding files comes to: (source_path, group, rel_path, id, status, stored_size, pack_file, codebook, storage).

    A file at the same source, package and relative path is ``imported`` already; a known content
    makes an entry that copies the first one's stored form; others are ``new``.
    """
    place = ["source_path", "group", "rel_path"]
    there = entries.select(*place, F.lit(True).alias("there")).distinct()
    form = F.struct("stored_size", "pack_file", "codebook", "storage")
    known = entries.groupBy("id").agg(F.min_by(form, "ord").alias("form"))
    out = new.select(*place, "id").join(there, place, "left").join(known, "id", "left")
    status = F.when(F.col("there"), "imported").when(F.col("form").isNotNull(), "dedup").otherwise("new")
    return out.select(*place, "id", status.alias("status"), F.coalesce("form.stored_size", F.lit(0)).alias("stored_size"), "form.pack_file", "form.codebook", "form.storage")


def replace_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """``entries`` with ``new`` ones in place of those at the same paths."""
    return entries.join(new.select("path").distinct(), "path", "left_anti").select(entries.columns).union(new.select(entries.columns))


def remove_entries(entries: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that stay, and the contents (content_key) that no entry names any more, each once."""
    from chunklake.operators.reports import keyed

    e = keyed(entries)
    kept = e.join(uids, "uid", "left_anti")
    gone = e.join(uids, "uid", "left_semi").select("content_key").distinct().join(kept.select("content_key"), "content_key", "left_anti")
    return kept.drop("content_key"), gone


def merge_entries(disk: DataFrame, local: DataFrame) -> DataFrame:
    """Three-way merge by uid. ``local`` has is_dirty and is_deleted.

    Rows that local deleted go; a dirty local row overrides the one on disk in its place, or is
    appended; clean local rows lose to the disk, and vanish if the disk has them no more.
    """
    names = [c for c in disk.columns if c != "uid"]
    d = disk.select("uid", F.struct(*names).alias("d"))
    mine = local.select("uid", F.struct(*names).alias("m"), "is_dirty", "is_deleted")
    both = d.join(mine, "uid", "full_outer").filter(~F.coalesce("is_deleted", F.lit(False)))
    use_local = F.coalesce("is_dirty", F.lit(False))
    both = both.filter(F.col("d").isNotNull() | use_local)
    row = F.when(use_local, F.col("m")).otherwise(F.col("d"))
    out = both.select("uid", row.alias("r"), F.when(F.col("d").isNotNull(), F.struct(F.lit(0).alias("side"), F.col("d.ord").alias("at"))).otherwise(F.struct(F.lit(1).alias("side"), F.col("m.ord").alias("at"))).alias("place"))
    return out.select("uid", *(F.col(f"r.{c}").alias(c) for c in names), F.col("place.side").alias("side"), F.col("place.at").alias("at")).orderBy("side", "at")


def merge_folders(disk: DataFrame, local: DataFrame, deleted: DataFrame, dirty: DataFrame) -> DataFrame:
    """(disk without deleted) and (local that is dirty)."""
    return disk.select("path").join(deleted, "path", "left_anti").union(local.select("path").join(dirty, "path", "left_semi")).distinct().orderBy("path")


def stat(paths: DataFrame, folders: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, kind, mode, size): attributes as a file system shows them."""
    first = entries.groupBy("path").agg(F.min_by(F.struct("mode", "size"), "ord").alias("e"))
    kinds = lookup(paths, folders, entries).join(first, "path", "left")
    return kinds.select("path", "kind", F.when(F.col("kind") == "dir", 0o755).when(F.col("kind") == "file", scalars.display_mode(F.col("e.mode"))).otherwise(0).alias("mode"), F.when(F.col("kind") == "file", F.col("e.size")).otherwise(0).alias("size"))
