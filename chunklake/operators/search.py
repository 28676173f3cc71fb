"""Search over the catalog and the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_rank(term: str) -> Column:
    """0 for an exact match, 1 for a partial one, else null; letter case doesn't count. The empty term matches all."""
    t = F.lower(F.lit(term))
    named = [F.lower(F.col(c)) for c in ("name", "group", "rel_path")]
    exact = F.startswith(F.col("id"), t)
    partial = F.lit(False)
    for c in named:
        exact, partial = exact | (c == t), partial | F.contains(c, t)
    return F.when(exact, 0).when(partial, 1)


def match(entries: DataFrame, term: str) -> DataFrame:
    """Entries that match: exact ones first, each kind in catalog order."""
    return entries.withColumn("rank", match_rank(term)).filter(F.col("rank").isNotNull()).orderBy("rank", "ord")


def _cut_bytes(line: Column, most: int) -> Column:
    """The line, or its longest prefix of whole characters within ``most`` bytes and an ellipsis."""
    fits = F.expr(f"filter(sequence(0, {most}), k -> octet_length(substring(line, 1, k)) <= {most})")
    return F.when(F.octet_length(line) <= most, line).otherwise(F.concat(F.substring(line, F.lit(1), F.array_max(fits)), F.lit("…")))


def grep(texts: DataFrame, term: str, most_bytes: int = 300) -> DataFrame:
    """(ord, line_no, line): lines that contain ``term`` in any letter case. A last empty line doesn't count; a carriage
    return before the newline goes; long lines are cut."""
    lines = texts.select("ord", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"), F.size(F.split("text", "\n", -1)).alias("n"))
    lines = lines.filter(~((F.col("line") == "") & (F.col("line_no") == F.col("n") - 1))).withColumn("line", F.regexp_replace("line", "\r$", ""))
    found = lines.filter(F.contains(F.lower("line"), F.lower(F.lit(term))))
    return found.select("ord", F.col("line_no").cast("long").alias("line_no"), _cut_bytes(F.col("line"), most_bytes).alias("line"))


def search(texts: DataFrame, term: str, scanned: int = 40, hits: int = 50) -> DataFrame:
    """Lines found as the panel shows them: in the first ``scanned`` entries, the first ``hits`` lines."""
    some = texts.orderBy("ord").limit(scanned)
    found = grep(some, term)
    order = Window.orderBy("ord", "line_no")  # at most the lines of `scanned` entries
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= hits).drop("n")
