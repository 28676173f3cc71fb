"""Near duplicates by SimHash fingerprints and a self-join of their binary tries.

A fingerprint is a bit string. All fingerprints form a binary trie; the self-join walks pairs of
nodes together from the root, adds up the bits in which their paths differ and drops a pair as soon
as the sum exceeds the error budget. The walk is cut into independent pieces for Spark: each
fingerprint enters one trie per ``block`` with that block rotated to the front, and a piece is one
node at the depth of a block. With ``budget`` differing bits and ``budget + 1`` blocks, every pair
within the budget agrees in some block (pigeonhole), so the join is complete.
A node with more than ``PIECE`` fingerprints isn't one piece: Spark joins its children into node
pairs, level by level and with the same budget, until the pieces are small.

The pipeline's stage allows more errors than blocks can hold. Its tries are dealt by the smallest
shingle hashes under independent seeds instead, and what the tries find is only a candidate: texts
are linked by the exact Jaccard similarity of their shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from xxhash import xxh3_128_digest, xxh64_digest, xxh64_intdigest

from chunklake.llm.common import LOWER_ASCII, among, as_bytes, cut, slices
from chunklake.llm.components import components

#: Fingerprints in one trie node, beyond which Spark splits the node.
PIECE = 20_000
#: Pairs of fingerprints under a pair of trie nodes, below which they are compared at once.
LEAF = 2_048
#: Node pairs that one step of the walk holds.
WIDTH = 1 << 18

BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"  # what bytes.split() takes as white space


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits (64,) that are set in over half of the uint64 ``hashes``."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int32) * 2 > len(hashes)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64 hash bits of each hash; k = 0 gives them as they are."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words joined by spaces; fewer words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, runs, repeat(42)), np.uint64)


def sketch(hashes: np.ndarray, n_words: int) -> bytes:
    """SimHash of ``n_words`` × 64 bits, most significant byte first; of no hashes, all zero."""
    if not len(hashes):
        return bytes(8 * n_words)
    return b"".join(np.packbits(_majority(_mixed(hashes, k))[::-1]).tobytes() for k in range(n_words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp binary(8)) of each row: SimHash of the word shingles, repeats counted.

    Words are what white space parts, A-Z in lower case. Null and blank texts have fingerprint zero.
    Long texts are hashed whole. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = [sketch(shingle_hashes(t.translate(LOWER_ASCII).split(), width), 1) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp binary")


def _first_difference(rows: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Byte index at which each sorted row leaves the row above; -1 where a unit begins; width if equal."""
    out = np.full(len(rows), -1, np.int32)
    differs = rows[1:] != rows[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    out[1:] = np.where(unit[1:] == unit[:-1], first, -1)
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, count), one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _product(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of ranges (start, count): all index pairs, and the pair's own number."""
    left_of, of = _ranges(a, na), np.repeat(np.arange(len(a)), na)
    reps = nb[of]
    return np.repeat(left_of, reps), _ranges(b[of], reps), np.repeat(of, reps)


def trie_pairs(rows: np.ndarray, unit: np.ndarray, roots: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``rows`` (n × bytes, sorted within units) that differ in at most ``budget`` bits.

    ``roots`` lists pairs of ranges (low a, high a, low b, high b); a range pair with itself is a
    self-join and gives i < j. The walk goes down one byte at a time, depth first over bounded
    batches of node pairs, and carries the differing bits of the paths so far.
    """
    leaves = _first_difference(rows, unit)
    stack = [(0, roots, np.zeros(len(roots), np.int32))]
    while stack:
        depth, pairs, errors = stack.pop()
        if len(pairs) > WIDTH:
            stack += [(depth, pairs[i : i + WIDTH], errors[i : i + WIDTH]) for i in range(0, len(pairs), WIDTH)]
            continue
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        small = (na * nb <= LEAF) | (depth == rows.shape[1])
        here = pairs[small]
        cost = np.cumsum((na * nb)[small])
        for lo, hi in _cuts(cost, 1 << 21):
            p = here[lo:hi]
            i, j, of = _product(p[:, 0], p[:, 1] - p[:, 0], p[:, 2], p[:, 3] - p[:, 2])
            keep = (p[of, 0] != p[of, 2]) | (i < j)
            i, j = i[keep], j[keep]
            near = _bits(rows[i] ^ rows[j]) <= budget
            yield i[near], j[near]
        pairs, errors = pairs[~small], errors[~small]
        if len(pairs):
            begins = np.flatnonzero(leaves <= depth)
            child = np.cumsum(leaves <= depth) - 1
            first_a, first_b = child[pairs[:, 0]], child[pairs[:, 2]]
            count_a, count_b = child[pairs[:, 1] - 1] + 1 - first_a, child[pairs[:, 3] - 1] + 1 - first_b
            ends = np.append(begins[1:], len(rows))
            for lo, hi in _cuts(np.cumsum(count_a * count_b), 1 << 21):
                a, b, of = _product(first_a[lo:hi], count_a[lo:hi], first_b[lo:hi], count_b[lo:hi])
                of = of + lo
                e = errors[of] + np.bitwise_count(rows[begins[a], depth] ^ rows[begins[b], depth])
                keep = (e <= budget) & ((pairs[of, 0] != pairs[of, 2]) | (a <= b))
                a, b, e = a[keep], b[keep], e[keep]
                if len(a):
                    stack.append((depth + 1, np.stack([begins[a], ends[a], begins[b], ends[b]], axis=1), e))


def _cuts(totals: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges over a running total, each of about ``most``; one item may exceed it."""
    lo = 0
    while lo < len(totals):
        hi = max(lo + 1, int(np.searchsorted(totals, (totals[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0 .. n - 1 over the edges (u, v)."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[u], at[v])
        new = at.copy()
        np.minimum.at(new, at[u], low)
        np.minimum.at(new, at[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == at).all():
            return at
        at = new


def _link(rows: np.ndarray, unit: np.ndarray, side: np.ndarray, node: np.ndarray, budget: int) -> pa.RecordBatch:
    """Links of whole units as a spanning forest: (node, root of the node within these units)."""
    order = np.lexsort([rows[:, k] for k in range(rows.shape[1] - 1, -1, -1)] + [side, unit])
    rows, unit, side, node = rows[order], unit[order], side[order], node[order]
    seg = unit * 2 + side
    starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    ends = np.append(starts[1:], len(seg))
    owner = unit[starts]
    if side.any():  # units of two sides: first range against second
        first = np.flatnonzero(np.append(owner[1:] == owner[:-1], False))
        roots = np.stack([starts[first], ends[first], starts[first + 1], ends[first + 1]], axis=1)
        alone = ~np.isin(owner, owner[first])
        roots = np.concatenate([roots, np.stack([starts, ends, starts, ends], axis=1)[alone & (side[starts] == 0)]])
    else:
        many = ends - starts > 1
        roots = np.stack([starts, ends, starts, ends], axis=1)[many]
    us, vs, held = [], [], 0
    at = np.arange(len(rows))
    for i, j in trie_pairs(rows, seg, roots, budget):
        us.append(i)
        vs.append(j)
        held += len(i)
        if held > 1 << 21:  # fold what was found into the forest
            at = _roots(len(rows), np.concatenate([*us, np.arange(len(rows))]), np.concatenate([*vs, at]))
            us, vs, held = [], [], 0
    at = _roots(len(rows), np.concatenate([*us, np.arange(len(rows))]), np.concatenate([*vs, at]))
    linked = at != np.arange(len(rows))
    return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[at[linked]])], ["u", "v"])


def _join_units(budget: int):
    """mapInArrow function over rows (unit long, side, s, node) sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(parts: list[tuple]) -> pa.RecordBatch:
            return _link(*(np.concatenate(x) for x in [*zip(*parts, strict=True)]), budget)

        for b in batches:
            if not b.num_rows:
                continue
            unit, raw = b.column(0).to_numpy(), b.column(2).to_pylist()
            part = (np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), unit, b.column(1).to_numpy().astype(np.int64), b.column(3).to_numpy())
            last = int(np.searchsorted(unit, unit[-1]))  # where the last unit begins, which may go on
            if last:
                held.append(tuple(x[:last] for x in part))
                yield flush(held)
                held = []
            elif held and held[-1][1][-1] != unit[0]:
                yield flush(held)
                held = []
            held.append(tuple(x[last:] for x in part))
        if held:
            yield flush(held)

    return run


def trie_links(reps: DataFrame, budget: int, blocks: int, piece: int = PIECE) -> DataFrame:
    """Links (u, v) of node ids, a spanning forest per piece, between near fingerprints.

    ``reps``: (node long, fp binary), one row for each distinct fingerprint. The fingerprint is dealt
    into ``blocks`` blocks of whole bytes; two fingerprints link if they agree in a block and differ
    in at most ``budget`` bits in all.
    """
    n_bytes = F.length("fp")
    size = F.floor(n_bytes / blocks).cast("int")
    turned = F.expr(f"transform(sequence(0, {blocks - 1}), t -> named_struct('t', t, 's', concat(substring(fp, t * size + 1), substring(fp, 1, t * size)), 'size', size))")
    rows = (
        reps.withColumn("size", size)
        .select("node", F.explode(turned).alias("r"))
        .select("node", F.col("r.t").alias("t"), F.col("r.s").alias("s"), F.expr("substring(r.s, 1, r.size)").alias("a"))
    )
    return _tries(rows, budget, piece)


def _tries(rows: DataFrame, budget: int, piece: int = PIECE) -> DataFrame:
    """Links (u, v) within each node (t, a) of the tries of ``rows`` (node, t, s, a); a is the start of s.

    A node whose rows all have one s has no pairs; s is distinct within (t, a) for each node.
    """
    counts = rows.groupBy("t", "a").count()
    big = cut(counts.filter(F.col("count") > piece))
    if big.isEmpty():
        units = rows.select(F.xxhash64("t", "a").alias("unit"), F.lit(0).alias("side"), "s", "node")
        return _run_units(units, budget)
    small = rows.join(big, ["t", "a"], "left_anti").select(F.xxhash64("t", "a").alias("unit"), F.lit(0).alias("side"), "s", "node")
    hot = cut(rows.join(big, ["t", "a"], "left_semi"))
    links = _run_units(small, budget)
    frontier = big.select("t", F.col("a").alias("pa"), F.col("a").alias("pb"), F.lit(0).alias("e"), F.col("count").alias("na"), F.col("count").alias("nb"))
    width = int(hot.select(F.length("s")).first()[0])
    depth = int(big.select(F.length("a")).first()[0])
    last = F.expr("conv(hex(substring(p, -1, 1)), 16, 10)").cast("int")
    while depth < width and not frontier.isEmpty():
        depth += 1
        kids = cut(hot.select("t", F.expr(f"substring(s, 1, {depth})").alias("p")).groupBy("t", "p").count().withColumn("parent", F.expr(f"substring(p, 1, {depth - 1})")).withColumn("digit", last))
        a = kids.select("t", F.col("parent").alias("pa"), F.col("p").alias("ca"), F.col("digit").alias("da"), F.col("count").alias("na"))
        b = kids.select("t", F.col("parent").alias("pb"), F.col("p").alias("cb"), F.col("digit").alias("db"), F.col("count").alias("nb"))
        pairs = cut(
            frontier.drop("na", "nb").join(a, ["t", "pa"]).join(b, ["t", "pb"])
            .filter((F.col("pa") != F.col("pb")) | (F.col("ca") <= F.col("cb")))
            .select("t", F.col("ca").alias("pa"), F.col("cb").alias("pb"), (F.col("e") + F.bit_count(F.col("da").bitwiseXOR(F.col("db")))).alias("e"), "na", "nb")
            .filter(F.col("e") <= budget)
        )
        over = (F.col("na") > piece) | (F.col("nb") > piece)
        ready = pairs if depth == width else pairs.filter(~over)
        of = ready.select("t", "pa", "pb", F.xxhash64("t", "pa", "pb").alias("unit"))
        at = hot.withColumn("p", F.expr(f"substring(s, 1, {depth})"))
        left = at.join(of.withColumnRenamed("pa", "p"), ["t", "p"]).select("unit", F.lit(0).alias("side"), "s", "node")
        right = at.join(of.filter("pa <> pb").withColumnRenamed("pb", "p"), ["t", "p"]).select("unit", F.lit(1).alias("side"), "s", "node")
        links = links.union(_run_units(left.union(right), budget))
        frontier = pairs.filter(over)
    return links


def _run_units(units: DataFrame, budget: int) -> DataFrame:
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_join_units(budget), "u long, v long")


def groups(marked: DataFrame, budget: int, blocks: int, piece: int = PIECE) -> DataFrame:
    """(fp, component) of each distinct fp of ``marked`` (id, fp).

    component is the smallest id reachable over links; copies share a fingerprint and are one node,
    so a group of copies of any size costs one row here. Rows with a null id count only if alone.
    """
    reps = cut(marked.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    found = components(trie_links(reps.select("node", "fp"), budget, blocks, piece))
    found = cut(found.join(reps.select("node", "least"), "node"))
    least = found.groupBy("root").agg(F.min("least").alias("component"))
    named = found.join(least, "root").select("node", "component")
    return cut(reps.join(named, "node", "left").select("fp", F.coalesce("component", "least").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of ``docs``.

    64-bit SimHash of ``width``-word shingles; fingerprints at ``budget`` (at most 7) or fewer
    differing bits link. component_id is the smallest id reachable, the row's own included.
    Repeated rows give repeated results; null texts have fingerprint zero, linked like any other;
    null ids keep their row, with component_id null unless they link to a known id. An empty table
    gives an empty result. Other columns of ``docs`` don't matter.
    """
    blocks = 4 if budget <= 3 else 8
    marked = cut(fingerprints(docs, id_col, text_col, width))
    out = marked.join(groups(marked, budget, blocks), "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Of the pipeline's stage: sketches of 4 × 64 bits.
SKETCH_WORDS = 4
#: Of the pipeline's stage: independently seeded tries, and how many smallest hashes name a node of each. Sets of
#: Jaccard 0.8 share no node with a probability of (1 - 0.8 ** MINIMA) ** TRIES, 6e-7.
TRIES, MINIMA = 20, 3
#: Shingle sets of a candidate component that one task compares, and their bytes; larger components are cut into chunks.
CHUNK, CHUNK_BYTES = 1_000, 64 << 20

_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (TRIES * MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text."""
    return np.unique(shingle_hashes(text.translate(LOWER_ASCII).split(), width))


def trie_keys(hashes: np.ndarray) -> bytes:
    """The node of a shingle set in each trie, 8 bytes each: a hash of its smallest hashes under the trie's seeds."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i : i + 4096] * _SEEDS).min(axis=1))
    return b"".join(xxh64_digest(x.tobytes(), t) for t, x in enumerate(low.reshape(TRIES, MINIMA)))


def marks(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, digest, size, fp, keys) of each row's shingle set: digest, hashes in it, 256-bit SimHash and trie nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingle_set(t, width) for t in as_bytes(b.column(1))]
            size = pa.array([len(x) for x in sets], pa.int64())
            digest, fp, keys = (pa.array(c, pa.binary()) for c in ([xxh3_128_digest(x.tobytes()) for x in sets], [sketch(x, SKETCH_WORDS) for x in sets], [trie_keys(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([b.column(0), digest, size, fp, keys], ["id", "digest", "size", "fp", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, digest binary, size long, fp binary, keys binary")


def candidates(reps: DataFrame, budget: int, piece: int = PIECE) -> DataFrame:
    """(node, digest, least, size, comp) of each shingle set in a candidate component of two or more.

    ``reps``: (node long, digest, least, size, fp, keys). Sets that share a node of a trie and whose
    SimHashes differ in at most ``budget`` bits are candidates, and sets of equal SimHash are; a
    SimHash enters a node once.
    """
    fps = reps.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("sets"))
    at = cut(reps.join(fps, "fp"))
    keys = F.expr(f"transform(sequence(0, {TRIES - 1}), t -> named_struct('t', t, 'a', substring(keys, t * 8 + 1, 8)))")
    rows = at.select(F.col("first").alias("node"), "fp", "sets", F.explode(keys).alias("r")).select("node", "sets", F.col("r.t").alias("t"), F.concat("r.a", "fp").alias("s"), F.col("r.a").alias("a"))
    once = rows.filter("sets = 1").union(rows.filter("sets > 1").distinct()).drop("sets")
    found = components(_tries(once, budget, piece))
    named = at.drop("fp", "keys").join(found.select(F.col("node").alias("first"), "root"), "first", "left")
    return named.filter("root is not null or sets > 1").select("node", "digest", "least", "size", F.coalesce("root", "first").alias("comp"))


def _read_sets(tasks: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``tasks`` (task, side, node, root, digest, least) with ``shingles``, 8 bytes each, sorted, for digest and least.

    They are hashed again from the text of a row with the id ``least``. If several rows have that id,
    those of another digest are left out; rows with the same one repeat the task's row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = cut(tasks.select(F.col("least").alias("id")).distinct())
    known = among(texts, "id", wanted, "left_semi")
    if not wanted.filter("id is null").isEmpty():
        known = known.union(texts.filter("id is null"))
    rows = known.join(tasks, known["id"].eqNullSafe(tasks["least"])).select("task", "side", "node", "root", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw = [shingle_set(t, width).tobytes() for t in as_bytes(b.column(5))]
            same = pa.array([xxh3_128_digest(x) == d for x, d in zip(raw, b.column(4).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(raw, pa.binary())], ["task", "side", "node", "root", "shingles"]).filter(same)

    return rows.mapInArrow(run, "task long, side int, node long, root long, shingles binary")


def _near_sets(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between the sets of a task whose Jaccard similarity is at least ``similarity``.

    Pairs that are joined already, by their roots or by links found before, aren't compared again, nor
    are pairs of one side (unless it is -1).
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flag = np.zeros(int(ids.max(initial=-1)) + 1, np.int32)
    group, out = roots.copy(), []
    for x in range(len(sets) - 1):
        less, more = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        open_ = (group != group[x]) & (less >= similarity * more - 1e-9) & (less > 0) & ((sides < 0) | (sides != sides[x]))
        open_[: x + 1] = False
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        own = ids[starts[x] : starts[x] + sizes[x]]
        flag[own] = 1
        for lo, hi in _cuts(np.cumsum(sizes[others]), 1 << 21):
            y = others[lo:hi]
            both = np.add.reduceat(flag[ids[_ranges(starts[y], sizes[y])]], np.cumsum(sizes[y]) - sizes[y])
            near = y[both * (1 + similarity) >= similarity * (sizes[y] + sizes[x]) - 1e-9]
            if len(near):
                out += [(int(nodes[x]), int(nodes[k])) for k in near]
                group[np.isin(group, group[near])] = group[x]
        flag[own] = 0
    return out


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) within each task of ``rows`` (task long, side int, node, root, shingles); a node's repeated rows are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        now = None

        def flush() -> pa.RecordBatch:
            side, node, root, raw = zip(*held.values(), strict=True)
            sets = [np.frombuffer(x, np.uint64) for x in raw]
            links = _near_sets(np.array(node), np.array(root), np.array(side), sets, similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for b in slices([batch], "shingles"):
                for task, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if task != now and held:
                        yield flush()
                        held = {}
                    now = task
                    held[row[1]] = tuple(row)
        if held:
            yield flush()

    rows = rows.select("task", "side", "node", "root", "shingles")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def _chunked(members: DataFrame, chunk: int) -> DataFrame:
    """``members`` (node, size, comp, ...) with n, the chunks of its component, and c, its own among them."""
    n = F.ceil(F.greatest(F.count("*") / chunk, F.sum("size") * 8 / CHUNK_BYTES))
    counts = members.groupBy("comp").agg(F.greatest(n, F.lit(1)).cast("int").alias("n"))
    return members.join(counts, "comp").withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))


def _crossed(members: DataFrame, sets: DataFrame, similarity: float, own: bool) -> DataFrame:
    """Links between the chunks of each component; with ``own`` also within them."""
    pairs = members.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).filter("c <> d" if not own else "true")
    task = F.xxhash64("comp", F.least("c", "d"), F.greatest("c", "d"))
    side = F.when(F.col("c") == F.col("d"), -1).when(F.col("c") < F.col("d"), 0).otherwise(1)
    return _compared(pairs.join(sets, "node").select(task.alias("task"), side.alias("side"), "node", "root", "shingles"), similarity)


def confirmed(members: DataFrame, read: Callable[[DataFrame], DataFrame], similarity: float, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of the nodes that link: components over exact Jaccard ``similarity`` within each component.

    ``members``: (node, digest, least, size, comp); ``read`` adds the shingles to rows of tasks. Every
    pair of a component is compared or joined already. Of a component of many chunks, each chunk is
    compared first, then one node of each group found, then, where groups are left apart, each pair of
    chunks.
    """
    at = cut(_chunked(members, chunk))
    inside = at.select(F.xxhash64("comp", "c").alias("task"), F.lit(-1).alias("side"), "node", F.col("node").alias("root"), "digest", "least")
    large = at.filter("n > 1")
    if large.isEmpty():
        return components(_compared(read(inside), similarity))
    links = cut(_compared(read(inside), similarity))
    sets = cut(read(large.select(F.lit(0).cast("long").alias("task"), F.lit(0).alias("side"), "node", F.col("node").alias("root"), "digest", "least")).select("node", "shingles"))
    large = large.select("node", "size", "comp", "n", "c")

    def rooted() -> DataFrame:
        return cut(large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))

    firsts = _chunked(rooted().filter("node = root").select("node", "size", "comp", "root"), chunk)
    links = cut(links.union(_crossed(firsts, sets, similarity, own=True)))
    now = rooted()
    apart = now.groupBy("comp").agg((F.min("root") < F.max("root")).alias("apart")).filter("apart").select("comp")
    return components(links.union(_crossed(now.join(apart, "comp"), sets, similarity, own=False)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, budget: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``docs`` with one row kept of each group of near duplicates: that with the smallest id.

    Two texts link if the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``similarity``; texts without a word link to each other. Candidates come from independently seeded
    tries (see candidates()) with ``budget`` differing bits of 256, twice what sets of Jaccard 0.8
    differ in on average; every candidate component is then compared exactly.
    Of repeated rows with the smallest id one stays. Rows with null ids fall to a known id of their
    group; of a group of null ids alone one row stays. All columns of ``docs`` are returned.
    Texts move between executors only where more than ``BROADCAST_IDS`` ids are wanted or dropped.
    """
    marked = cut(marks(docs, id_col, text_col, width))
    reps = cut(marked.groupBy("digest", "size", "fp", "keys").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    members = cut(candidates(reps, budget))
    found = confirmed(members, lambda tasks: _read_sets(tasks, docs, id_col, text_col, width), similarity, chunk)
    found = cut(found.join(members.select("node", "digest", "least"), "node"))
    named = found.join(found.groupBy("root").agg(F.min("least").alias("component")), "root").select("digest", "root", "component")
    named = cut(reps.select("digest", "node", "least").join(named, "digest", "left").select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("component", "least").alias("component")))
    known = marked.filter("id is not null").select("id", "digest").join(named, "digest").groupBy("component", "id").count()
    known = cut(known.filter("count > 1 or id <> component"))  # of the other rows nothing changes
    gone = cut(known.filter("id <> component").select("id"))
    kept = among(docs, id_col, gone, "left_anti")
    repeated = cut(known.filter("id = component").select("id"))
    if not repeated.isEmpty():
        kept = among(kept, id_col, repeated, "left_anti").union(among(kept, id_col, repeated, "left_semi").dropDuplicates([id_col]))
    if marked.filter("id is null").isEmpty():
        return kept
    alone = named.filter("component is null").select(F.col("digest").alias("_digest"), F.col("root").alias("_root"))
    nameless = _with_digest(docs.filter(F.col(id_col).isNull()), text_col, width).join(alone, "_digest").dropDuplicates(["_root"])
    return kept.filter(F.col(id_col).isNotNull()).union(nameless.select(docs.columns))


def _with_digest(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """``docs`` with ``_digest``, that of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            digest = pa.array([xxh3_128_digest(shingle_set(t, width).tobytes()) for t in as_bytes(b.column(text_col))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, digest], [*b.schema.names, "_digest"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_digest", BinaryType())]))
