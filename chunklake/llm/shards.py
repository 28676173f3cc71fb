"""Sharding by balanced label propagation: equal texts move together under quotas, and sizes stay even.

Documents with equal texts are linked. The copies of a text in one shard are one row, a bundle
(key, shard, n), so a group of any size has at most one row for each shard. In each round bundles
move to the shard where most copies of their text are, as far as that shard's quota and the rows that
leave it at the same time allow; so rows change places even if no shard has room. Large groups go
first, while all room is free; the others start where room is left. Texts without a copy have no
link; they fill the shards afterwards. A global order of (label, key, id) is then cut into shards of
equal counts, which moves only the few rows by which labels miss the quota.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import cut, drop_table

#: Rounds at most; they end when no bundle can move.
ROUNDS = 12
#: Share of a shard that linked rows may take; the others in it take up what labels miss the exact counts by.
LINKED = 0.95
#: Where linked rows are more than that, their even share of a shard times this; the order moves whole groups to the next shard.
OVER = 1.05
#: A group is large from this share of a shard.
LARGE = 1 / 16


def _unit(*columns) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def _by_shard(shard: F.Column, values: list[float]) -> F.Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), shard + 1)


def _loads(bundles: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.n for r in bundles.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _fill(u: F.Column, room: list[float]) -> F.Column:
    """A shard for a number in [0, 1), each as likely as its share of the room."""
    edges = [sum(room[: s + 1]) / (sum(room) or 1.0) for s in range(len(room))]
    return reduce(lambda otherwise, s: F.when(u < edges[s], s).otherwise(otherwise), reversed(range(len(room))), F.lit(len(room) - 1))


def flows(wanted: dict[tuple[int, int], int], room: list[float]) -> dict[tuple[int, int], float]:
    """Rows that may move between shards, of those ``wanted`` by (from, to): a shard takes in no more than its room and what leaves it.

    Only sums by shard come in here. Each step scales down what comes into a shard by too much; what
    then stays in other shards lessens their allowance, so the steps go on until all hold.
    """
    now = {k: float(n) for k, n in wanted.items() if n and k[0] != k[1]}
    for _ in range(200):
        changed = False
        for to in {b for _, b in now}:
            come = sum(x for (_, b), x in now.items() if b == to)
            may = max(0.0, room[to]) + sum(x for (a, _), x in now.items() if a == to)
            if come > may * 1.001 + 1e-6:
                changed = True
                now = {(a, b): x * may / come if b == to else x for (a, b), x in now.items()}
        if not changed:
            break
    return now


def propagate(bundles: DataFrame, quotas: list[float], rounds: int = ROUNDS, only_open: bool = False) -> DataFrame:
    """Bundles (key long, shard int, n long) after label propagation; no shard takes in rows much beyond its quota of them.

    Each round is a join of the bundles with the best shard of their key, with ``only_open`` the best
    that has room, so a group of more than a shard fills one after another. Shards and rounds are few,
    so only sums by pairs of shards come to the driver. A bundle that is large against what may move
    goes in part; small ones go whole, a share of them by a hash if not all may.
    """
    now, shards = cut(bundles), len(quotas)
    for k in range(rounds):
        room = [max(0.0, q - n) for q, n in zip(quotas, _loads(now, shards), strict=True)]
        place = F.struct("n", F.xxhash64("key", "shard").alias("tie"), "shard")
        is_open = _by_shard(F.col("shard"), [float(r >= max(1.0, q / 50)) for r, q in zip(room, quotas, strict=True)]) > 0 if only_open else F.lit(True)
        best = now.groupBy("key").agg(F.max(F.when(is_open, place)).alias("best"))
        ahead = F.col("best").isNotNull() & (F.col("best") > place)
        wish = cut(now.join(best, "key").select("key", "shard", "n", F.when(ahead, F.col("best.shard")).alias("to")))
        wanted = {(r.shard, r["to"]): r.n for r in wish.filter(F.col("to").isNotNull()).groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        may = flows(wanted, room)
        if not wanted or sum(may.values()) < 1:
            break
        pair = F.col("shard") * shards + F.col("to")
        cells = [may.get((a, b), 0.0) for a in range(shards) for b in range(shards)]
        share = _by_shard(pair, [x / wanted.get((i // shards, i % shards), 1) for i, x in enumerate(cells)])
        large = F.col("n") > F.greatest(F.lit(1.0), _by_shard(pair, cells) / 50)
        moved = F.when(F.col("to").isNull(), 0).when(large, F.floor(F.col("n") * share)).when(_unit("key", "shard", F.lit(k)) < share, F.col("n")).otherwise(0)
        moves = wish.withColumn("m", moved.cast("long"))
        after = moves.select("key", "shard", (F.col("n") - F.col("m")).alias("n")).union(moves.filter("m > 0").select("key", F.col("to").alias("shard"), F.col("m").alias("n")))
        held = [now, wish]
        now = cut(after.groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        for table in held:
            drop_table(table)
    return now


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 8; text_crc32: of the UTF-8 bytes; both take a null text as empty. law is
    ``rows``: the shards' counts are at most one apart. slot numbers the rows of a shard from 0
    without gaps. grown_shard is null under this law. Repeated rows and null ids are placed like
    any other; an empty table gives an empty result; fewer rows than shards leave shards empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    total = rows.count()
    quota = total / shards
    linked = cut(rows.groupBy("key").agg(F.count("*").alias("total")).filter("total > 1"))
    copies = linked.agg(F.sum("total")).first()[0] or 0
    most = [max(LINKED * quota, OVER * copies / shards)] * shards
    is_large = F.col("total") >= max(2.0, LARGE * quota)  # of large keys there are at most shards / LARGE
    home = F.pmod(F.xxhash64("id", F.lit("home")), F.lit(shards)).cast("int")

    def bundled(keys: DataFrame, at: F.Column) -> DataFrame:  # counts first, so that the join meets a key once for each shard
        return rows.groupBy("key", at.alias("shard")).agg(F.count("*").alias("n")).join(keys, "key", "left_semi")

    large = propagate(bundled(F.broadcast(linked.filter(is_large).select("key")), home), most, rounds, only_open=True)
    left = [max(0.0, q - n) for q, n in zip(most, _loads(large, shards), strict=True)]
    small = propagate(bundled(linked.filter(~is_large).select("key"), _fill(_unit("id", F.lit("home")), left)), left, rounds)
    free = [max(0.0, quota - a - b) for a, b in zip(_loads(large, shards), _loads(small, shards), strict=True)]

    def ladders(bundles: DataFrame) -> DataFrame:  # a key has at most one bundle for each shard
        return bundles.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("ladder"), F.sum("n").alias("total"))

    hot = F.broadcast(ladders(large))  # at most shards / LARGE keys, which may hold most rows: these stay where they are
    climbing = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(ladders(small), "key", "left"))
    step = F.pmod(F.xxhash64("id", F.lit("spread")), F.col("total"))
    climb = F.aggregate(
        F.col("ladder"),
        F.struct(step.alias("left"), F.lit(-1).alias("shard")),
        lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.when((a["shard"] < 0) & (a["left"] < x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard")),
    )["shard"]
    fill = _fill(_unit("id", F.lit("fill")), free)
    part = F.when(F.col("ladder").isNotNull(), 1).when(_unit("id", F.lit("part")) < 0.5, 0).otherwise(2)
    labelled = climbing.select("id", "size", "text_crc32", "key", F.coalesce(climb, fill).alias("label"), part.alias("part"))
    order = ["label", "part", "key", "id"]
    placed = cut(labelled.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = placed.select("id", "size", "text_crc32", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"))
    starts, before = [], 0
    for r in numbered.groupBy("p").count().orderBy("p").collect():  # a row for each partition
        starts.append((r.p, before))
        before += r["count"]
    ranked = numbered.join(F.broadcast(docs.sparkSession.createDataFrame(starts, "p int, start long")), "p").withColumn("r", F.col("start") + F.col("i"))
    each, more = divmod(total, shards)
    in_larger = F.col("r") < more * (each + 1)
    where = F.when(in_larger, F.expr(f"r div {each + 1}")).otherwise(F.expr(f"{more} + (r - {more * (each + 1)}) div {max(1, each)}"))
    slot = F.when(in_larger, F.col("r") % (each + 1)).otherwise((F.col("r") - more * (each + 1)) % max(1, each))
    return ranked.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), where.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
