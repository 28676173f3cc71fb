"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic. A token's emission is a sum of weights of its features (the word and
its first letters); a 2 × 2 matrix scores transitions. Tokens are labelled by distant supervision:
in a labelled document the tokens whose features mark toxic documents and hardly occur in clean
ones. Forward-backward marginals give each token's chance to be toxic, and from them the score of
the document and the offsets of the offending tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.llm.common import bounded_sample, slices

#: Bounds of the labelled sample: rows of either label, and bytes of text in all.
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_BYTES = 1_200, 2_400, 32 << 20
#: Lengths of the prefixes that are features of a word.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature marks toxic text if its odds between toxic and clean sample documents are at least so high, and chance
#: would give so uneven counts to fewer than one feature in SURE times the number of its kind.
LEAST_ODDS, SURE = 12.0, 10.0
#: Sample documents that a feature must occur in, to have a weight; how strongly weights are drawn to 0, those of
#: marking features and others; steps of the fit.
SUPPORT, MARK_RIDGE, RIDGE, STEPS = 5, 0.02, 1.0, 40
#: Marginal from which a token is an offending one.
OFFENDING = 0.5

WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Features of a word in lower case."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of whole texts: number of tokens of each, each token's index among the distinct tokens, and those."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = parts.flatten().dictionary_encode()
    return pc.list_value_length(parts).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


@dataclass
class Model:
    """Weights of the features for toxic (clean: 0), transition scores [from, to], and the curve that gives a document's score."""

    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self._seen: dict[str, float] = {}

    def emission(self, token: str) -> float:
        """Score of toxic against clean of a white-space token: that of its worst word."""
        words = WORD.findall(token)
        return self.bias + max((sum(self.weights.get(f, 0.0) for f in features(w)) for w in words), default=0.0)

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if len(self._seen) > 300_000:
            self._seen.clear()
        found = list(map(self._seen.get, tokens))
        for i, f in enumerate(found):
            if f is None:
                found[i] = self._seen[tokens[i]] = self.emission(tokens[i])
        return np.array(found, np.float64)

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Chance of toxic of every token; ``emissions`` holds the documents one after another."""
        forward, backward = self.forward_backward(emissions, lengths)
        return _sigmoid(forward + backward - emissions)

    def forward_backward(self, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of toxic of each token from the tokens up to it, and from it to the end; both with its own emission."""
        starts = np.zeros(len(emissions), bool)
        starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        forward = _chain(emissions, starts, self.transitions)
        ends = np.roll(starts, -1)[::-1] if len(starts) else starts
        return forward, _chain(emissions[::-1], ends, self.transitions.T)[::-1]

    def document_scores(self, marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Score of each document by the calibrated curve; 0 without tokens."""
        return np.where(lengths > 0, _sigmoid(evidence(marginals, lengths) @ np.array(self.curve)), 0.0)


def evidence(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: log odds of its largest marginal, log of 1 + the expected toxic tokens, and 1."""
    out = np.zeros((len(lengths), 3))
    out[:, 2] = 1
    has = lengths > 0
    begin = (np.cumsum(lengths) - lengths)[has]
    if len(begin):
        worst = np.clip(np.maximum.reduceat(marginals, begin), 1e-9, 1 - 1e-9)
        out[has, 0] = np.log(worst) - np.log1p(-worst)
        out[has, 1] = np.log1p(np.add.reduceat(marginals, begin))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _step(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds after one transition from log odds ``x``."""
    return np.logaddexp(t[0, 1], t[1, 1] + x) - np.logaddexp(t[0, 0], t[1, 0] + x)


def _chain(emissions: np.ndarray, starts: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of toxic of each token from the tokens up to it in its document.

    The recursion is sequential in a document; it runs here for many stretches of all documents at
    once. A stretch that begins inside a document first reads the tokens before it until the odds
    don't depend on where they began: one transition shrinks a difference by the factor
    tanh-contraction of ``t``, so a fixed lead brings it under 1e-12.
    """
    n = len(emissions)
    if not n:
        return emissions
    odds = abs(t[0, 0] + t[1, 1] - t[0, 1] - t[1, 0])
    shrink = np.tanh(odds / 4)
    lead = int(np.ceil(np.log(1e-13 / 60) / np.log(max(shrink, 1e-6)))) + 1
    width = max(64, lead)
    n_rows = -(-n // width)
    padded = np.zeros((n_rows + 1) * width)
    padded[width : width + n] = emissions
    fresh = np.ones((n_rows + 1) * width, bool)
    fresh[width : width + n] = starts
    grid, first = padded.reshape(-1, width), fresh.reshape(-1, width)
    x = np.zeros(n_rows)
    for k in range(width - lead, width):  # the lead: the end of the stretch before
        x = np.where(first[:-1, k], 0.0, _step(x, t)) + grid[:-1, k]
    out = np.empty((n_rows, width))
    for k in range(width):
        x = np.where(first[1:, k], 0.0, _step(x, t)) + grid[1:, k]
        out[:, k] = x
    return out.reshape(-1)[:n]


def _distinct(lows: list[np.ndarray]) -> list[int]:
    """Indices of the documents without near copies of earlier ones, by their smallest word hashes."""
    holders: dict[int, list[int]] = {}
    kept = []
    for i, low in enumerate(lows):
        shared = Counter(j for h in low.tolist() for j in holders.get(h, ()))
        if len(low) and any(n >= 0.4 * len(low) for n in shared.values()):
            continue
        kept.append(i)
        for h in low.tolist():
            holders.setdefault(h, []).append(i)
    return kept


def _kind(feature: str) -> int:
    """Length of a prefix, 0 for a whole word."""
    return 0 if feature[0] == "=" else len(feature)


def _marking(kinds: np.ndarray, with_toxic: np.ndarray, with_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features mark toxic documents beyond chance, by the documents of either label that hold them.

    Chance: the Chernoff bound that so many of a feature's documents are toxic, against the features of its kind.
    """
    if not n_toxic or not n_clean:
        return np.zeros(len(kinds), bool)
    base, both = n_toxic / (n_toxic + n_clean), np.maximum(with_toxic + with_clean, 1)
    q = np.clip(with_toxic / both, 1e-12, 1)
    surprise = both * (q * np.log(q / base) + np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - base)), 0))
    of_kind = np.bincount(kinds[with_toxic > 0], minlength=max(PREFIXES) + 1)
    odds = (with_toxic + 0.1) * n_clean >= LEAST_ODDS * (with_clean + 0.1) * n_toxic
    return (with_toxic > 0) & odds & (surprise >= np.log(SURE * np.maximum(of_kind[kinds], 1)))


class _Sample:
    """The tokens of sample texts and their features, as numbers: token k of document i, features of each distinct token."""

    def __init__(self, texts: list[str]) -> None:
        self.lengths, self.which, distinct = _tokens(pa.array(texts, pa.string()))
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])
        names: dict[str, int] = {}
        of = [sorted({names.setdefault(f, len(names)) for w in WORD.findall(t) for f in features(w)}) for t in distinct]
        self.tokens, self.names = distinct, list(names)
        self.rows = np.repeat(np.arange(len(of)), [len(x) for x in of]).astype(np.int64)
        self.cols = np.array([k for x in of for k in x], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64)
        self.kinds = np.array([_kind(f) for f in self.names], np.int64)
        self.hashes = np.array([crc32(f.encode()) for f in self.names], np.int64)

    def features_of(self, i: int) -> np.ndarray:
        """Distinct features of document i."""
        own = np.unique(self.which[self.begin[i] : self.begin[i + 1]])
        return np.unique(np.concatenate([self.cols[self.first[k] : self.first[k + 1]] for k in own])) if len(own) else own

    def counts(self, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Of each feature: documents, toxic and clean ones without near copies; and these documents' numbers."""
        everywhere, by = np.zeros(len(self.names)), np.zeros((2, len(self.names)))
        held: tuple[list, list] = ([], [])
        for i in range(len(self.lengths)):
            fs = self.features_of(i)
            everywhere[fs] += 1
            held[int(toxic[i])].append((fs, np.sort(self.hashes[fs[self.kinds[fs] == 0]])[:32] if len(fs) else fs))
        n = [0, 0]
        for label in (0, 1):
            kept = _distinct([low for _, low in held[label]])
            n[label] = len(kept)
            for k in kept:
                by[label][held[label][k][0]] += 1
        return everywhere, by[1], by[0], n[1], n[0]


def pair_counts(model: Model, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every token, and the expected number of each transition [from, to], by forward-backward."""
    forward, backward = model.forward_backward(emissions, lengths)
    p = _sigmoid(forward + backward - emissions)
    document = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.flatnonzero(document[1:] == document[:-1])
    a, b, t = forward[inside], backward[inside + 1], model.transitions
    x = np.stack([np.full(len(inside), t[0, 0]), t[0, 1] + b, a + t[1, 0], a + t[1, 1] + b])
    x = np.exp(x - x.max(axis=0))
    return p, (x / x.sum(axis=0)).sum(axis=1).reshape(2, 2)


def _train(texts: list[str], toxic: np.ndarray) -> Model:
    """Fit the field to the sample: label tokens, then climb the likelihood of the labelled chains.

    Emissions have a weight for each feature of SUPPORT documents or more, whether it marks toxic text
    or not; these, the bias and the transitions follow observed minus expected counts.
    """
    sample = _Sample(texts)
    lengths, which, n_tokens = sample.lengths, sample.which, len(sample.tokens)
    everywhere, *by_label = sample.counts(toxic)
    marks = _marking(sample.kinds, *by_label)
    marked = np.bincount(sample.rows, weights=marks[sample.cols], minlength=n_tokens) > 0
    document = np.repeat(np.arange(len(lengths)), lengths)
    y = (marked[which] & toxic[document]).astype(np.int64)
    used = np.flatnonzero((everywhere >= SUPPORT) | marks)
    number = np.full(len(sample.names), -1)
    number[used] = np.arange(len(used))
    keep = number[sample.cols] >= 0
    rows, cols = sample.rows[keep], number[sample.cols[keep]]
    inside = np.append(document[1:] == document[:-1], False)[: len(y)]
    seen = np.bincount(y[:-1][inside[:-1]] * 2 + y[1:][inside[:-1]], minlength=4).reshape(2, 2).astype(float)
    count = np.bincount(which, minlength=n_tokens).astype(float)
    of_feature = np.bincount(cols, weights=count[rows], minlength=len(used))
    ridge = np.where(marks[used], MARK_RIDGE, RIDGE)
    w, bias, t = np.zeros(len(used)), -4.0, np.zeros((2, 2))
    velocity, bias_velocity, t_velocity = np.zeros(len(used)), 0.0, np.zeros((2, 2))
    for _ in range(STEPS):
        token = bias + np.bincount(rows, weights=w[cols], minlength=n_tokens)
        p, expected = pair_counts(Model({}, bias, t), token[which], lengths)
        residual = np.bincount(which, weights=y - p, minlength=n_tokens)
        gradient = np.bincount(cols, weights=residual[rows], minlength=len(used)) - ridge * w
        velocity = 0.8 * velocity + gradient / (1 + 0.25 * of_feature + ridge) * 0.5
        bias_velocity = 0.8 * bias_velocity + float((y - p).sum()) / max(1.0, float((p * (1 - p)).sum())) * 0.1
        t_velocity = 0.8 * t_velocity + (seen - expected - t) / (10.0 + np.minimum(seen, expected) + 0.05 * np.abs(seen - expected)) * 0.1
        w, bias = np.clip(w + velocity, -12, 12), float(np.clip(bias + bias_velocity, -12, 0))
        t = np.clip(t + t_velocity, -2.0, 2.0)
    weights = {sample.names[k]: float(w[i]) for i, k in enumerate(used.tolist()) if abs(w[i]) >= 1e-3}
    model = Model(weights, bias, t)
    model.curve = _calibrate(evidence(model.marginals(model.emissions(sample.tokens)[which], lengths), lengths), toxic.astype(float))
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Coefficients of a logistic curve from ``x`` to ``y`` by damped Newton steps; those of evidence aren't negative."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0, 0.0
    w = np.array([0.5, 0.0, 0.0])
    ridge = np.array([0.5, 0.5, 1e-3])
    for _ in range(60):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -1, 1)
        w[:2] = np.maximum(w[:2], [0.05, 0.0])
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from labelled rows of ``docs`` (the caller leaves out held-out ones).

    At most ``toxic_sample`` and ``clean_sample`` rows are used, the first by a hash of the id, of these
    so many that all texts together have at most ``sample_bytes``; a text over half of that isn't used
    to learn from. They are fitted in one task. Several labels of one id count as the largest. Without
    labels of both kinds the model marks nothing.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    toxic = bounded_sample(known.filter("label = 1"), id_col, toxic_sample)
    ids = toxic.union(bounded_sample(known.filter("label = 0"), id_col, clean_sample))
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(ids), id_col).filter(F.octet_length("text") <= sample_bytes // 2)
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col, "text").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("_upto", upto).filter(F.col("_upto") <= sample_bytes // 2)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "text"]).drop_duplicates("text")
        m = _train(pdf.text.tolist(), pdf.label.to_numpy() == 1)
        rows = [*m.weights.items(), (" bias", m.bias), *((f" curve{i}", c) for i, c in enumerate(m.curve))]
        rows += [(f" {i}{j}", m.transitions[i, j]) for i in (0, 1) for j in (0, 1)]
        return pd.DataFrame(rows, columns=["name", "value"])

    rows = chosen.select(F.col(id_col).cast("string").alias("id"), "text", "label").groupBy().applyInPandas(train, "name string, value double").collect()
    values = {r.name: r.value for r in rows}
    if not values:
        return Model({}, -12.0, np.zeros((2, 2)))
    transitions = np.array([[values.pop(f" {i}{j}") for j in (0, 1)] for i in (0, 1)])
    bias, curve = values.pop(" bias"), tuple(values.pop(f" curve{i}") for i in range(3))
    return Model(values, bias, transitions, curve)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a last column ``toxicity`` struct(score, spans).

    score (0 to 1) comes from the largest marginal of a token and the sum of marginals of the whole
    text, calibrated on the labelled sample; null and blank texts score 0. spans: character offsets [start, end) and
    marginal of the offending tokens in the original text. A column of ``docs`` called toxicity is
    replaced. No shuffle.
    """
    docs = docs.drop("toxicity")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names[at], 2 << 20):
            lengths, which, distinct = _tokens(b.column(at))
            p = held.value.marginals(held.value.emissions(distinct)[which], lengths)
            begin = np.cumsum(lengths) - lengths
            blank = pc.equal(pc.ascii_trim_whitespace(pc.fill_null(b.column(at).cast(pa.string()), "")), "").to_numpy(zero_copy_only=False)
            scores = np.where(blank, 0.0, held.value.document_scores(p, lengths))
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            hits = np.flatnonzero(p >= OFFENDING)
            owner = np.searchsorted(begin, hits, "right") - 1
            for i in np.unique(owner):
                places = _places(b.column(at)[int(i)].as_py())
                found[i] = [{"start": places[k - begin[i]][0], "end": places[k - begin[i]][1], "marginal": float(p[k])} for k in hits[owner == i]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], [*names, "score", "spans"])

    flat = docs.toDF(*names)
    schema = flat.select("*", F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<start:int,end:int,marginal:double>>)").alias("spans")).schema
    return flat.mapInArrow(run, schema).select(*names, F.struct("score", "spans").alias("toxicity")).toDF(*docs.columns, "toxicity")


def _places(text: str) -> list[tuple[int, int]]:
    """Offsets of the tokens, empty ones at the ends included, as the splitter counts them."""
    out, at = [], 0
    for gap in re.finditer(r"[ \t\n\v\f\r]+", text):
        out.append((at, gap.start()))
        at = gap.end()
    return [*out, (at, len(text))]
