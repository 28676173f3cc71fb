"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import cut, drop_table

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, held: list[DataFrame]) -> DataFrame:
    """One star step. ``edges`` has (u, v) once for each undirected edge; ``held`` takes the table that it writes.

    The minimum of each neighbourhood comes from a partial aggregate, is written, and is joined back:
    a hub never has its neighbours in one group, and a skewed join of two plain tables can be split.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(high.alias("u"), low.alias("v"))
    held.append(mins := cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))))
    joined = both.join(mins, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); root is the smallest node reachable.

    Nodes without an edge to another node aren't listed. Nulls, loops and repeated edges are ignored.
    Each round writes its edges to the shared folder, so lost executors cost one round at most, and
    deletes those of the round before.
    """
    now = cut(edges.dropna().filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == before or not sign[0]:
            break
        before, held = sign, [now]
        now = cut(_star(_star(now, True, held), False, held))
        for table in held:
            drop_table(table)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
