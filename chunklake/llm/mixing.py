"""Mixing sources to target weights by hierarchical budgets over a tree of domain, language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.llm.common import among, cut

LEVELS = ("domain", "lang", "source")
#: Rows of a leaf's sample order that a bucket holds, about; a bucket is ordered in one task.
BUCKET_ROWS = 10_000
#: Rows of the tree or of the bucket sums up to which they are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def tokens(text: Column) -> Column:
    """Number of words, parted by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: dict[str, str], otherwise: str = "other") -> Column:
    """The domain of a source by a mapping."""
    if not domains:
        return F.lit(otherwise)
    return F.coalesce(F.create_map(*(F.lit(x) for item in domains.items() for x in item))[source], F.lit(otherwise))


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (…, cap, weight, budget of the parent) with ``got``: the parent's budget dealt out by weight.

    No child gets more than its cap; what it can't take goes to its siblings by weight. As a node's
    cap is the sum of what lies below it, a shortage stays among siblings while they have room, and
    only then reaches the siblings of the parent. Tokens that whole numbers leave over go one each to
    the first children by name that have room.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy("ratio", "name")
    left = F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_from = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumn("ratio", ratio).withColumn("left", left.cast("double")).withColumn("weight_from", weight_from.cast("double"))
    fits = (F.col("cap").cast("double") * F.col("weight_from") <= F.col("weight").cast("double") * F.col("left")).cast("int")
    nodes = nodes.withColumn("full", F.min(fits).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*parent)
    rest = F.col("budget").cast("double") - F.coalesce(F.sum(F.when(F.col("full") == 1, F.col("cap"))).over(whole), F.lit(0)).cast("double")
    weights = F.sum(F.when(F.col("full") == 0, F.col("weight"))).over(whole).cast("double")
    got = F.when(F.col("full") == 1, F.col("cap")).when(weights > 0, F.least(F.col("cap"), F.floor(F.col("weight").cast("double") * rest / weights))).otherwise(0)
    nodes = nodes.withColumn("got", got.cast("long"))
    open_ = ((F.col("full") == 0) & (F.col("weight") > 0) & (F.col("got") < F.col("cap"))).cast("int")
    over = F.col("budget") - F.sum("got").over(whole)
    rank = F.sum(open_).over(Window.partitionBy(*parent).orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    more = ((open_ == 1) & (rank <= over)).cast("long")
    return nodes.withColumn("got", F.col("got") + more).drop("ratio", "left", "weight_from", "full")


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[str, int] | None = None) -> DataFrame:
    """Budget of each leaf: ``leaves`` (domain, lang, source, tokens) with ``budget``.

    The root has ``share`` of all tokens. ``weights`` holds the target weights of nodes by their path
    ("web", "web/en", …), or by their name under any parent ("*/en"); those of siblings count against
    each other. A node without one has the whole part of the root of its tokens, which tempers large
    nodes. Only the tree passes through here, in windows over the children of a node.
    """
    leaves = leaves.filter("tokens > 0")
    at = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    dealt = leaves.sparkSession.createDataFrame([(int(total * share),)], "budget long").withColumn("root", F.lit(0))
    parent = ["root"]
    for k in range(1, len(LEVELS) + 1):
        path = list(LEVELS[:k])
        nodes = at.withColumn("root", F.lit(0)).groupBy(*parent, *(c for c in path if c not in parent)).agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"))
        weight = F.floor(F.sqrt(F.col("tokens").cast("double"))).cast("long")
        if weights:
            table = F.create_map(*(F.lit(x) for item in weights.items() for x in item))
            anywhere = [table[F.concat_ws("/", F.lit("*"), path[-1])]] if k > 1 else []
            weight = F.coalesce(*(x.cast("long") for x in (table[F.concat_ws("/", *path)], *anywhere)), weight)
        nodes = nodes.withColumn("weight", weight).withColumn("name", F.col(path[-1])).join(dealt, parent)
        dealt = cut(_share(nodes, parent).select(*path, "tokens", F.col("got").alias("budget")))
        parent = path
        if k < len(LEVELS):
            dealt = dealt.select(*path, "budget")
    return dealt


def mix(docs: DataFrame, share: float = 1.0, max_epochs: int = 4, seed: int = 17, weights: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domains: dict[str, str] | None = None) -> DataFrame:
    """(id, domain, lang, source, tokens, budget, copies): how often each document of ``docs`` enters the mixture.

    A leaf with a budget of f times its tokens and some more takes all its documents f times, then
    the longest prefix of the next epoch that fits; each epoch has its own order, by a hash of seed,
    epoch and id. ``domains`` maps sources to domains; others are of domain "other". Rows of one leaf that share an id are one document; null languages and sources
    count as ''. Leaves without tokens get no budget and copies 0. An empty table gives no rows.
    """
    leaf = list(LEVELS)
    source = F.coalesce(F.col(source_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), domain_of(source, domains or {}).alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), source.alias("source"), tokens(F.col(text_col)).alias("tokens"))
    units = cut(narrow.groupBy("id", *leaf).agg(F.sum("tokens").alias("tokens")))
    totals = cut(units.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    plan = budgets(totals.drop("n"), share, max_epochs, weights)
    plan = plan.select(*leaf, "budget", F.expr("budget div tokens").alias("epoch"), F.expr("budget % tokens").alias("rest"))
    most = totals.agg(F.max("n")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, most / BUCKET_ROWS), 16)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    n_leaves = totals.count()
    ordered = units.join(F.broadcast(plan) if n_leaves <= BROADCAST_ROWS else plan, leaf, "left").withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    sums = ordered.groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("in_bucket"))
    running = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(running), F.lit(0))))
    placed = ordered.join(F.broadcast(sums) if n_leaves * 16**digits <= BROADCAST_ROWS else sums, [*leaf, "bucket"])
    at_edge = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_bucket") > F.col("rest"))
    within = Window.partitionBy(*leaf, "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ["id", *leaf, "tokens", "budget"]
    epoch = F.coalesce(F.col("epoch"), F.lit(0))
    edge = placed.filter(at_edge).withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    rest = placed.filter(~at_edge | F.col("budget").isNull())
    chosen = edge.select(*out, (epoch + (F.col("upto") <= F.col("rest")).cast("int")).alias("copies")).union(
        rest.select(*out, (epoch + F.coalesce((F.col("before") + F.col("in_bucket") <= F.col("rest")).cast("int"), F.lit(0))).alias("copies"))
    )
    return chosen.select(F.col("id").alias(id_col), *leaf, "tokens", F.coalesce("budget", F.lit(0)).alias("budget"), F.col("copies").cast("int").alias("copies"))


def taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` that enter the mixture of mix() at least once, with the same columns.

    The ids left out are broadcast up to a counted bound, so that texts stay where they are.
    """
    gone = cut(mix(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias("id")).agg(F.max("copies").alias("most")).filter("most = 0").select(F.col("id").cast("long").alias("id")))
    kept = among(docs, id_col, gone.dropna(), "left_anti")
    return kept if gone.filter("id is null").isEmpty() else kept.filter(F.col(id_col).isNotNull())
