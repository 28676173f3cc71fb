"""Boilerplate lines by their frequency relative to the site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import cut

#: Sites up to which the boilerplate hashes are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SITES = 5_000
#: Hashes of all sites together up to which they are broadcast (8 bytes each).
BROADCAST_HASHES = 500_000


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """(site, hashes): hashes of the lines on more than ``ratio`` of a site's pages, and on at least ``least``.

    ``pages``: (site, lines array<string>). A line counts once for each page. The hashes of a site
    number at most its lines per page divided by ``ratio``.
    """
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    distinct = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    counts = pages.select("site", F.explode(distinct).alias("h")).groupBy("site", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.join(totals, "site").filter(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("site").agg(F.collect_list("h").alias("hashes"))


def drop_boilerplate(pages: DataFrame, site: Column, ratio: float = 0.01, least: int = 3, text_col: str = "text") -> DataFrame:
    """``pages`` with last columns ``line_dedup`` struct(text, n_lines, n_dropped).

    A line is dropped if over ``ratio`` of the pages of its site hold it, and at least ``least``.
    Lines are parted by newlines and compared by their XXH64 within a site; blank lines stay. A null text stays null and
    has no lines; pages without a site (null) are one site. Repeated rows are pages of their own.
    A column of ``pages`` called line_dedup is replaced.
    """
    pages = pages.drop("line_dedup")
    names = [f"c{i}" for i in range(len(pages.columns))]
    flat = pages.select(F.struct(*(pages[c].alias(n) for c, n in zip(pages.columns, names, strict=True))).alias("row"), F.coalesce(site, F.lit("")).alias("site"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    found = cut(boilerplate(flat.select("site", "lines"), ratio, least))
    size = found.agg(F.count("*").alias("sites"), F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("hashes")).first()
    if size.sites <= BROADCAST_SITES and size.hashes <= BROADCAST_HASHES:
        found = F.broadcast(found)
    kept = F.filter("lines", lambda x: ~F.array_contains("hashes", F.xxhash64(x)))
    joined = flat.join(found, "site", "left").withColumn("kept", F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(kept))
    n_lines, n_kept = (F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long") for c in ("lines", "kept"))
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n"))
    return joined.select(*(F.col(f"row.{n}").alias(c) for n, c in zip(names, pages.columns, strict=True)), F.struct(text.alias("text"), n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")).alias("line_dedup"))
