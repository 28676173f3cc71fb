"""Scalar functions of the catalog as columns; no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes, each 1024 times the one before.
UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")


def human_size(size: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``5.2 MB``; halves round to even."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS, 1):
        scaled = F.format_string("%.1f", F.bround(size.cast("double") / float(1024**k), 1))
        out = F.when(size >= 1024**k, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for a whole of 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * ratio(part, whole)


def is_trash(path: Column) -> Column:
    return path.contains("/.Trash-") | path.contains("/.Trash/")


def content_key(storage: Column, content_id: Column, pack_file: Column) -> Column:
    """What an entry's stored bytes are counted under."""
    return F.when(storage == "blocks", F.concat(F.lit("blocks:"), content_id)).otherwise(pack_file)


def uses_codebook(legacy: Column, encrypt: Column) -> Column:
    """Whether an entry goes through the codebook format: asked for, or encrypted."""
    return legacy | (encrypt != "")


def is_content_id(value: Column) -> Column:
    return (F.length(value) == 64) & value.rlike("^[0-9a-fA-F]{64}$")


def normal_folder(folder: Column) -> Column:
    """Absolute folder without blanks around, doubled or trailing slashes; ``.`` and ``..`` are resolved."""
    parts = F.filter(F.split(F.trim(folder), "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda kept, p: F.when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(done, "/"))


def parent_of(path: Column) -> Column:
    """Folder of an absolute path; "/" at the top."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def canonical_path(folder: Column, rel: Column) -> Column:
    """Path of an entry. A folder that already ends in the directories of ``rel`` isn't repeated."""
    dirs = F.when(rel.contains("/"), F.regexp_replace(rel, "/[^/]*$", "")).otherwise(".")
    ends = (folder != "/") & (dirs != ".") & F.endswith(folder, dirs)
    stem = F.substring(folder, F.lit(1), F.length(folder) - F.length(dirs))
    joined = F.when(folder == "/", F.concat(F.lit("/"), rel)).otherwise(F.concat(folder, F.lit("/"), rel))
    return F.when(ends, F.concat(stem, F.lit("/"), rel)).otherwise(joined)


def archive_parts(path: Column, top: str = "/arquivos") -> Column:
    """struct(is_archive, folder, grp, rel) of a path below the folder of packages."""
    inside = F.startswith(path, F.lit(top + "/"))
    rest = F.substring(path, F.lit(len(top) + 2), F.length(path))
    group = F.split_part(rest, F.lit("/"), F.lit(1))
    rel = F.when(F.contains(rest, F.lit("/")), F.substring(rest, F.length(group) + 2, F.length(rest))).otherwise("")
    return F.struct(
        inside.alias("is_archive"),
        F.when(inside, F.concat(F.lit(top + "/"), group)).otherwise("").alias("folder"),
        F.when(inside, group).otherwise("").alias("grp"),
        F.when(inside, rel).otherwise("").alias("rel"),
    )


def codebook_name(path: Column, suffix: str = ".codebook") -> Column:
    """Base name of a codebook file without its suffix; '' for none."""
    return F.regexp_replace(base_name(F.coalesce(path, F.lit(""))), suffix.replace(".", "\\.") + "$", "")


def parse_hit_rate(output: Column) -> Column:
    """First number of the first line that begins with ``Hit Rate:``; 0 without one."""
    found = F.regexp_extract(output, r"(?m)^\s*Hit Rate:[^0-9\n]*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(0.0))


def display_mode(mode: Column) -> Column:
    """0755 if any may execute, else 0644."""
    return F.when(mode.bitwiseAND(0o111) != 0, 0o755).otherwise(0o644)


def pack_flags(fast: Column, encrypt: Column, codebook: Column) -> Column:
    """Flags of a pack command as an array, without those that don't apply."""
    flags = F.array(F.when(fast, "--fast"), F.when(encrypt != "", "--encrypt"), F.when(codebook != "", F.concat(F.lit("--codebook="), codebook)))
    return F.filter(flags, lambda x: x.isNotNull())


def entry_uid(path: Column, content_id: Column) -> Column:
    """A stable id in place of a random one."""
    return F.substring(F.sha2(F.concat(path, content_id), 256), 1, 16)


def recipe_bytes(n_chunks: Column, one_block: Column) -> Column:
    """Bytes of a recipe's record: the short form for a content of one block."""
    return F.when(one_block, 12 + 33).otherwise(F.lit(12 + 33 + 24) + n_chunks * 36)


def last_line(text: Column) -> Column:
    return F.element_at(F.split(F.trim(F.regexp_replace(text, r"\s+$", "")), "\n"), -1)


def zlib_header(raw: Column, at: int = 1) -> Column:
    """Whether a binary starts like a zlib stream: deflate, window up to 32 KiB, check bits, no preset dictionary."""
    first, second = (F.conv(F.hex(F.substring(raw, at + i, 1)), 16, 10).cast("int") for i in (0, 1))
    return (F.octet_length(raw) >= 2) & (first % 16 == 8) & (first / 16 < 8) & ((first * 256 + second) % 31 == 0) & (second.bitwiseAND(32) == 0)


def ancestors(folder: Column) -> Column:
    """All folders above and including a folder, from "/" down."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    deep = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(F.size(parts) == 0, F.array(F.lit("/"))).otherwise(deep)


def below(path: Column, folder: Column) -> Column:
    """Whether ``path`` lies under ``folder``; /ab isn't under /a."""
    prefix = F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"))
    return F.startswith(path, prefix)
