"""Language identification by the nearest of several n-gram centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.llm.common import slices

#: Hash buckets of the byte 2-grams and 3-grams.
BUCKETS = 1 << 13
#: Bound of the sample that gives the centroids, for each language.
SAMPLE = 1_200
CENTROIDS = 4
#: Share of a language's sample that lies within its rejection distance, and a factor on that distance.
WITHIN, SLACK = 0.995, 1.05
#: Share of the sample texts nearest to a centroid that must be of its language.
PURE = 0.8
#: Rows counted in one step.
ROWS = 64

UNKNOWN = "und"

#: ASCII letters and all bytes of other characters stay; the rest parts words.
_LETTERS = np.array([b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)], np.uint8)


def ngram_counts(texts: pa.Array) -> np.ndarray:
    """Counts (rows × BUCKETS) of the byte 2- and 3-grams of whole texts, in lower case, words padded."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    padded = pc.binary_join_element_wise("", lower, "", " ")
    offsets = np.frombuffer(padded.buffers()[1], np.int32)[padded.offset : padded.offset + len(padded) + 1]
    if len(padded) == 0 or offsets[-1] == offsets[0]:
        return np.zeros((len(padded), BUCKETS), np.int64)
    data = _LETTERS[np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    row = np.repeat(np.arange(len(padded), dtype=np.int32), np.diff(offsets))
    keep = np.append(True, (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1]))
    data, row = data[keep].astype(np.uint32), row[keep].astype(np.int64)
    two = data[:-1] * np.uint32(0x9E3779B1) ^ data[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0x27D4EB2F) ^ data[2:] * np.uint32(0x165667B1)
    row *= BUCKETS
    ends2, ends3 = row[1:] == row[:-1], row[2:] == row[:-2]
    keys = np.concatenate([(row[1:] + (two >> np.uint32(19)))[ends2], (row[2:] + (three >> np.uint32(19)))[ends3]])
    return np.bincount(keys, minlength=len(padded) * BUCKETS).reshape(len(padded), BUCKETS)


def _steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, column):
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and in how many each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for b in _steps(batches, "text"):
            n += b.num_rows
            df += (ngram_counts(b.column(0)) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, BUCKETS), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        if r.bucket >= 0:
            out[r.bucket] = r.n
    return next((r.n for r in rows if r.bucket < 0), 0), out


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, seeded with rows at even ranks of likeness to the mean: unit centroids, and each row's own."""
    rank = np.argsort(x @ x.mean(axis=0), kind="stable")
    k = min(k, len(x))
    c = x[rank[(np.arange(k) * 2 + 1) * len(x) // (2 * k)]]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, (x @ c.T).argmax(axis=1)


@dataclass
class Model:
    """idf (BUCKETS), unit centroids (n × BUCKETS) with their languages and rejection distances."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray

    def nearest(self, texts: pa.Array) -> np.ndarray:
        return (tfidf(ngram_counts(texts), self.idf) @ self.centroids.T).argmax(axis=1)

    def purged(self, votes: dict[int, dict[str, int]]) -> Model:
        """Without the centroids that wrongly named texts made: those nearest to too many texts of other languages.

        Of each language at least the purest centroid stays.
        """
        pure = np.array([votes.get(i, {}).get(name, 0) / max(1, sum(votes.get(i, {}).values())) for i, name in enumerate(self.languages)])
        keep = [i for i, name in enumerate(self.languages) if pure[i] >= min(PURE, max(p for p, other in zip(pure, self.languages, strict=True) if other == name))]
        return Model(self.idf, self.centroids[keep], [self.languages[i] for i in keep], self.limits[keep])

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of the nearest centroid, its cosine, and whether the distance exceeds its limit."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        near = tfidf(ngram_counts(texts), self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
        lettered = pc.match_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), r"\p{L}").to_numpy(zero_copy_only=False)
        language = [self.languages[i] if a else UNKNOWN for i, a in zip(best, lettered, strict=True)]
        return language, np.where(lettered, cosine, 0.0), ~lettered | (1 - cosine > self.limits[best])


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from the rows of ``docs`` with a language (the caller leaves out held-out ones).

    Document frequencies cover all those rows. The centroids come from at most ``sample`` rows of
    each language, the first by a hash of the id, clustered in one task per language from their counts.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n, df = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    # A hash thins each language to a few times the sample before the window ranks the rest.
    share = known.groupBy("lang").agg(F.count("*").alias("rows")).select("lang", (F.lit(4.0 * sample) / F.col("rows")).alias("share"))
    h = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    thin = known.select("id", "lang", h.alias("h")).join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "id")
    ids = thin.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample)
    chosen = known.join(F.broadcast(ids.select("id", "lang").distinct()), ["id", "lang"])  # at most `sample` rows for each language

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches, "text"):
            counts = ngram_counts(b.column(1))
            used = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(used, pa.list_(pa.int32())), pa.array([c[u] for c, u in zip(counts, used, strict=True)], pa.list_(pa.int32()))], ["lang", "digest", "buckets", "counts"])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("digest").sort_values("digest")
        x = np.zeros((len(pdf), BUCKETS), np.float32)
        for i, (at, n) in enumerate(zip(pdf.buckets, pdf.counts, strict=True)):
            x[i, at] = n
        x = tfidf(x, idf)
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "limit": []})
        c, own = cluster(x, k)
        distance = 1 - (x * c[own]).sum(axis=1)
        used = [i for i in range(len(c)) if (own == i).any()]
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "centroid": [c[i].astype("<f4").tobytes() for i in used], "limit": float(np.quantile(distance, WITHIN)) * SLACK})

    counted = chosen.select("lang", "text", F.md5("text").alias("digest")).mapInArrow(sparse, "lang string, digest string, buckets array<int>, counts array<int>")
    got = counted.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, limit double").toPandas()
    got = got.assign(_c=[bytes(c) for c in got.centroid]).sort_values(["lang", "_c"])
    vectors = np.stack([np.frombuffer(bytes(c), "<f4") for c in got.centroid]) if len(got) else np.zeros((0, BUCKETS), np.float32)
    model = Model(idf, vectors, got.lang.tolist(), got.limit.to_numpy(np.float64))
    return model.purged(_votes(chosen.select("lang", "text").distinct(), model))


def _votes(sample: DataFrame, model: Model) -> dict[int, dict[str, int]]:
    """Of each centroid: how many sample texts of each language are nearest to it."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.nearest(b.column(1)), pa.int32())], ["lang", "centroid"])

    out: dict[int, dict[str, int]] = {}
    if model.languages:
        for r in sample.mapInArrow(run, "lang string, centroid int").groupBy("centroid", "lang").count().collect():
            out.setdefault(r.centroid, {})[r.lang] = r["count"]
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a last column ``language`` struct(lang_pred, score, rejected).

    lang_pred: language of the nearest centroid, ``und`` for a null text or one without a letter;
    score: its cosine (0 to 1); rejected: the text lies farther from the centroid than nearly all
    the texts it was learned from, so its language may be none of the learned ones. Whole texts
    count. A column of ``docs`` called language is replaced. No shuffle.
    """
    docs = docs.drop("language")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches, names[at]):
            language, score, rejected = held.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    flat = docs.toDF(*names)
    schema = flat.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return flat.mapInArrow(run, schema).select(*names, F.struct("lang_pred", "score", "rejected").alias("language")).toDF(*docs.columns, "language")
