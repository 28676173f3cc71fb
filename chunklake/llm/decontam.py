"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import as_bytes, slices

#: Words in a window.
WINDOW = 10
#: Nodes of one automaton at most, of some 60 bytes each; a larger benchmark is dealt into several automata, scanned one
#: after another. Windows of one item that stay together.
AUTOMATON_NODES, PIECE = 4_000_000, 10_000
#: The second sign of a word is one of so many: a node's edges are searched one by one, so no node may have many.
SIGNS = 128

#: Bytes 00-2F, 3A-40, 5B-60 and 7B-7F part words; A-Z become a-z; all others belong to words.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)


def normal(text: bytes) -> bytes:
    """Text of equal length with words in lower case and every other byte a space."""
    return text.translate(_NORMAL)


def windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """Runs of ``width`` words; fewer words make one run."""
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def _code(k: int) -> str:
    """Two signs for the k-th word; those of the second place are no first ones, so words never match across their bounds."""
    first = 1 + SIGNS + k // SIGNS
    return chr(first if first < 0xD800 else first + 0x800) + chr(1 + k % SIGNS)


class Automaton:
    """Aho-Corasick over windows of words; each distinct word of the benchmark has two signs, all others two NULs."""

    def __init__(self, items: list[tuple[str | None, str]], width: int) -> None:
        self.codes: dict[bytes, str] = {}
        owners: dict[str, tuple[str, ...]] = {}
        shared: dict[tuple, tuple] = {}  # one object for the many windows of an item
        for item_id, text in items:
            own = () if item_id is None else (item_id,)
            words = normal(text.encode()).split(b" ")
            for w in windows([w for w in words if w], width):
                key = "".join(self.codes.get(x) or self.codes.setdefault(x, _code(len(self.codes))) for x in w)
                ids = tuple(sorted({*owners.get(key, ()), *own}))
                owners[key] = shared.setdefault(ids, ids)
        self.found = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.found.add_word(key, shared.setdefault((len(key) // 2, ids), (len(key) // 2, ids)))
        if owners:
            self.found.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit ranges of words [first, end) in order and disjoint, ids of items that occur."""
        words = normal(text).split()
        if not words or not self.codes:
            return len(words), [], set()
        hit: list[tuple[int, int]] = []
        ids: set[str] = set()
        ranges = []
        for last, (n, own) in self.found.iter("".join(map(self.codes.get, words, repeat("\0\0")))):
            ranges.append((last // 2 + 1 - n, last // 2 + 1))
            ids.update(own)
        for first, end in sorted(ranges):
            if hit and first <= hit[-1][1]:
                hit[-1] = (hit[-1][0], max(hit[-1][1], end))
            else:
                hit.append((first, end))
        return len(words), hit, ids


_built: dict[tuple[str, int], Automaton] = {}


def _automaton(items: Broadcast, width: int) -> Automaton:
    """The automaton of a block of items, built once in each Python worker that keeps to the block."""
    name, texts = items.value
    if (name, width) not in _built:
        _built.clear()
        _built[name, width] = Automaton(texts, width)
    return _built[name, width]


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, most: int) -> list[Broadcast]:
    """Broadcast the items in blocks whose windows have about ``most`` nodes, counted before a block is collected.

    A long item comes in pieces that overlap by all but one word of a window, so it may be in several blocks.
    """
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"), F.lit(1))
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), words.alias("w")).filter("size(w) > 0").distinct()
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("w") - width, F.lit(0))) / PIECE).cast("int"))
    pieces = items.select("id", F.explode(F.transform(starts, lambda i: F.slice("w", i * PIECE + 1, PIECE + width - 1))).alias("w"))
    nodes = F.greatest(F.size("w") - (width - 1), F.lit(1)) * F.least(F.size("w"), F.lit(width)) * 2
    total = pieces.agg(F.sum(nodes)).first()[0] or 0
    n = 1 + int(total) // most
    texts = pieces.select("id", F.array_join("w", " ").alias("text"), F.pmod(F.xxhash64("w"), F.lit(n)).alias("block"))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast((uuid4().hex, [(r.id, r.text) for r in texts.filter(F.col("block") == k).collect()])) for k in range(n)]


_STATE = "n_words long, hits array<struct<first:int,last:int>>, items array<string>"


def _pass(items: Broadcast, width: int, text_at: int, state_at: int):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, width)
        for b in batches:
            for s in slices([b], b.schema.names[text_at]):
                counts, hits, ids = [], [], []
                before = zip(s.column(state_at + 1).to_pylist(), s.column(state_at + 2).to_pylist(), strict=True)
                for t, (h0, i0) in zip(as_bytes(s.column(text_at)), before, strict=True):
                    n, h, i = automaton.scan(t)
                    counts.append(n)
                    hits.append(_merged(h, [(x["first"], x["last"]) for x in h0]) if h0 else h)
                    ids.append(sorted(i.union(i0)))
                new = [pa.array(counts, pa.int64()), pa.array([[{"first": x, "last": y} for x, y in h] for h in hits], kind), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(s.columns[:state_at] + new, names=s.schema.names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, block_nodes: int = AUTOMATON_NODES) -> DataFrame:
    """``docs`` with a last column ``contamination`` struct(n_words, hits, items).

    hits: disjoint word ranges [first, last) inside occurrences of benchmark windows, adjoining ones
    joined; items: sorted ids of the items with an occurring window. Each text is scanned whole, once
    per automaton (one, unless the benchmark's windows exceed ``block_nodes``). No shuffle of documents.
    Null or empty texts have no words; null benchmark texts have no window; items with a null id hit
    but aren't listed; repeated items count once. An empty benchmark hits nothing. A column of
    ``docs`` that is itself called contamination is replaced.
    """
    docs = docs.drop("contamination")
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    at, end = docs.columns.index(text_col), len(names)
    state = flat.select("*", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    for block in _blocks(benchmark, item_col, item_text, width, block_nodes):
        state = state.mapInArrow(_pass(block, width, at, end), state.schema)
    out = state.select(*names, F.struct("n_words", "hits", "items").alias("contamination"))
    return out.toDF(*docs.columns, "contamination")


def n_hit(column: str = "contamination") -> F.Column:
    return F.aggregate(F.col(f"{column}.hits"), F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])


def spans(text: str | None, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of ranges of words."""
    raw = (text or "").encode()
    marks = np.frombuffer(normal(raw), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    chars = np.cumsum(np.append(0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in hits]


def with_spans(found: DataFrame, text_col: str = "text", column: str = "contamination") -> DataFrame:
    """The result of contamination() with ``spans``: character offsets of the hits in the original texts."""

    def of(texts, hits):
        import pandas as pd

        return pd.Series([[{"start": a, "end": b} for a, b in spans(t, [(h["first"], h["last"]) for h in hs])] for t, hs in zip(texts, hits, strict=True)])

    mapped = F.pandas_udf(of, "array<struct<start:int,end:int>>")
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    hit = F.size(F.col(f"{column}.hits")) > 0
    return found.withColumn("spans", F.coalesce(mapped(F.when(hit, F.col(text_col)), F.col(f"{column}.hits")), empty))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs, with the same columns."""
    return contamination(docs, benchmark, **names).filter(F.size("contamination.hits") == 0).select(docs.columns)
