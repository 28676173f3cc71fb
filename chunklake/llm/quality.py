"""Quality by nearest neighbours: labelled latent-semantic vectors vote on every document.

Terms of a text are hashed: its words, the shapes of its tokens (letter case, digits, marks), pairs
of neighbouring shapes, and whether a token repeats the ones before. Document frequencies come from
all documents. A bounded, class-balanced sample of labelled rows spans the latent space (truncated
SVD of TF-IDF vectors) and is broadcast; each document is compared with all of it, in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import bounded_sample, crc_mod, slices

#: Hash buckets of shapes, pairs of shapes, repeats, words.
SHAPES, PAIRS, REPEATS, WORDS = 256, 512, 8, 1024
TERMS = SHAPES + PAIRS + REPEATS + WORDS
#: Shares of tokens equal to the one before, beyond which all tokens count under a further term, if they are so many.
REPEAT_SHARES, REPEAT_LEAST = (0.05, 0.2, 0.5), 4
#: Bound of the labelled sample, for each class.
SAMPLE = 2_000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Weight of a neighbour: similarity to this power.
SHARPNESS = 4
#: Characters of a token, beyond which it counts as several.
PIECE = 64


class _Kinds(dict):
    """Letter case, digit, or the mark itself, of a code point."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = kind = ord("A" if c.isupper() or c.istitle() else "a" if c.isalpha() else "0" if c.isdigit() else c)
        return kind


class _Letters(dict):
    """Letters, and nothing for all other code points."""

    def __missing__(self, code: int) -> int | None:
        self[code] = code if chr(code).isalpha() else None
        return self[code]


_RUN = re.compile(r"([aA0])\1+")
_kinds, _letters = _Kinds(), _Letters()
_seen: dict[str, int] = {}


def _token(token: str) -> int:
    """Shape bucket × WORDS + word bucket."""
    shape = _RUN.sub(r"\1", token.translate(_kinds))
    word = token.lower().translate(_letters)
    return crc32(shape.encode()) % SHAPES * WORDS + crc32(word.encode()) % WORDS


def _tokens(unique: list[str]) -> np.ndarray:
    if len(_seen) > 300_000:
        _seen.clear()
    found = list(map(_seen.get, unique))
    for i, f in enumerate(found):
        if f is None:
            found[i] = _seen[unique[i]] = _token(unique[i])
    return np.array(found, np.int64)


def _pieces(tokens: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Tokens and their rows, with those of over PIECE characters cut into several."""
    if (pc.max(pc.utf8_length(tokens)).as_py() or 0) <= PIECE:
        return tokens, row
    cut = [[t[i : i + PIECE] for i in range(0, max(1, len(t)), PIECE)] for t in tokens.to_pylist()]
    return pa.array([p for ps in cut for p in ps], pa.string()), np.repeat(row, [len(ps) for ps in cut])


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts (rows × TERMS) of the terms of whole texts; null and blank texts have none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    tokens, row = _pieces(parts.flatten(), np.repeat(np.arange(len(lengths)), lengths))
    coded = tokens.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    unique = coded.dictionary.to_pylist()
    blank = np.array([not u for u in unique], bool)
    if blank.any():
        full = ~blank[which]
        which, row = which[full], row[full]
    code = _tokens(unique)[which] if len(unique) else which
    shape, word = code // WORDS, code % WORDS
    same = row[1:] == row[:-1]
    pair = (shape[:-1] * 31 + shape[1:]) % PAIRS
    terms = [row * TERMS + shape, (row[1:] * TERMS + SHAPES + pair)[same], row * TERMS + SHAPES + PAIRS + REPEATS + word]
    repeated = np.zeros(len(lengths))
    for back in range(1, 4):
        again = (row[back:] == row[:-back]) & (which[back:] == which[:-back])
        terms.append((row[back:] * TERMS + SHAPES + PAIRS + back)[again])
        if back == 1:
            repeated = np.bincount(row[1:][again], minlength=len(lengths))
    out = np.bincount(np.concatenate(terms), minlength=len(lengths) * TERMS).reshape(len(lengths), TERMS)
    n = np.bincount(row, minlength=len(lengths))
    for i, share in enumerate(REPEAT_SHARES):  # a text that repeats its tokens over and over
        out[:, SHAPES + PAIRS + 4 + i] = np.where((repeated >= REPEAT_LEAST) & (repeated > share * n), n, 0)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and in how many each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(TERMS, np.int64)
        for b in _blocks(batches):
            n += b.num_rows
            df += (term_counts(b.column(0)) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, TERMS), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["term", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS, np.int64)
    for r in rows:
        if r.term >= 0:
            out[r.term] = r.n
    return next((r.n for r in rows if r.term < 0), 0), out


@dataclass
class Model:
    """idf (TERMS), axes (TERMS × dimensions), labelled vectors (rows × dimensions) and labels (rows)."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = self.weighted(counts) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the weighted vote; 0 for a text without terms, 0.5 without labelled rows."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        top = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS + 1e-12
        score = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.where(counts.any(axis=1), np.clip(score, 0, 1), 0.0)


def _axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a seeded start."""
    rng = np.random.default_rng(42)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], dimensions + 16)).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dimensions].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """Learn from the labelled rows of ``docs`` (the caller leaves out held-out ones).

    At most ``sample`` labelled rows of each class are used, the first by a hash of the id; several
    labels of one id count as the largest. Document frequencies cover all rows of ``docs``.
    """
    n, df = document_frequencies(docs, text_col)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    ids = None
    for value in (0, 1):
        part = bounded_sample(known.filter(F.col("label") == value), id_col, sample)
        ids = part if ids is None else ids.union(part)
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(ids), id_col).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            counts = term_counts(b.column(0))
            rows, terms = np.nonzero(counts)
            cut_at = np.searchsorted(rows, np.arange(len(counts) + 1))
            used = [terms[cut_at[i] : cut_at[i + 1]] for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(used, pa.list_(pa.int32())), pa.array([counts[i, t] for i, t in enumerate(used)], pa.list_(pa.int32()))], ["label", "terms", "counts"])

    got = chosen.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, terms array<int>, counts array<int>").toPandas()
    if got.empty:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    counts = np.zeros((len(got), TERMS), np.float32)
    for i, (t, c) in enumerate(zip(got.terms, got.counts, strict=True)):
        counts[i, t] = c
    model = Model(idf, np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), got.label.to_numpy(np.float64))
    model.axes = _axes(model.weighted(counts), min(dimensions, len(got)))
    model.vectors = model.latent(counts)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a last column ``score_col`` (0 to 1) of each whole text; a column of that name is replaced.

    Null and blank texts score 0. The model is broadcast: its size is bounded by the sample.
    """
    docs = docs.drop(score_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, f"c{at}"):
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(held.value.scores(term_counts(s.column(at))), pa.float64())], [*names, "score"])

    flat = docs.toDF(*names)
    return flat.mapInArrow(run, flat.select("*", F.lit(0.5).alias("score")).schema).toDF(*docs.columns, score_col)


def learn_fold(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows whose crc32(id as text) mod 3 is not 1."""
    return labels.filter(crc_mod(id_col, 3) != 1)
