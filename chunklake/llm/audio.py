"""Chroma fingerprints of recordings, and their alignment.

A recording becomes frames of twelve pitch-class energies; filters over an integral image of the
frames give two bits each, packed into one 32-bit integer per frame. Two recordings align at an
offset if many of their integers are equal at that offset (the peak of a histogram of offsets) and
few bits differ over the overlap. The histogram is a join on the integers: an inverted index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import cut

#: Samples of a frame and between frames; frames that a filter may span; frames transformed at once.
FRAME, HOP, SPAN, STEP_FRAMES = 1024, 256, 16, 2048
#: Reference pitch and the range of frequencies that count.
PITCH_A, LOWEST, HIGHEST = 440.0, 60.0, 3520.0
#: Filters; and the values between which a filter's two bits change, on either side of 0.
FILTERS, STEP = 16, 0.25
#: Share of differing bits up to which a candidate is a match, and shared frames at least; half of the shorter recording must be shared too. Of a recording of fewer frames all must be shared, and the
#: share of bits that may differ is smaller in proportion, as chance finds a place for a few frames in any long recording.
BIT_ERRORS, OVERLAP = 0.18, 24
#: Query keys that are broadcast at most: 32 MB of rows. Beyond, an integer of more than HOT recordings is salted.
BROADCAST_ROWS, HOT = 1_000_000, 100_000


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames): sizes and places by rule, so that they differ."""
    return [(i % 5, (i * 5) % 12, 12 if i % 4 == 3 else 4 + 2 * (i % 3), (4, 8, 12, 16)[i // 4]) for i in range(FILTERS)]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Unit vectors of the energies of the pitch classes (frames × 12); silent frames are 0."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (hz >= LOWEST) & (hz <= HIGHEST)
    pitch = np.eye(12)[np.round(12 * np.log2(np.maximum(hz, 1) / PITCH_A)).astype(int)[used] % 12]
    taper = np.hanning(FRAME).astype(np.float32)
    energy = np.concatenate([np.sqrt(np.abs(np.fft.rfft(windows[i : i + STEP_FRAMES] * taper, axis=1))[:, used] ** 2 @ pitch) for i in range(0, len(windows), STEP_FRAMES)])
    size = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(size > 1e-6 * FRAME, energy / np.maximum(size, 1e-12), 0).astype(np.float32)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """Packed integers (uint32) of the frames; fewer frames than a filter spans give none."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    wide = np.concatenate([frames, frames], axis=1)  # pitch classes go round
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = wide.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        a, b = image[t : t + n], image[t + w : t + w + n]
        return b[:, y + h] - b[:, y] - a[:, y + h] + a[:, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in _filters():
        half_h, half_w, third_h, third_w = h // 2, w // 2, h // 3, w // 4
        if kind == 0:  # lower against upper pitch classes
            a, b = area(0, w, y, half_h) / half_h, area(0, w, y + half_h, h - half_h) / (h - half_h)
        elif kind == 1:  # before against after
            a, b = area(0, half_w, y, h) / h, area(half_w, w - half_w, y, h) / h
        elif kind == 2:  # the diagonals
            a = area(0, half_w, y, half_h) + area(half_w, w - half_w, y + half_h, h - half_h)
            b = area(0, half_w, y + half_h, h - half_h) + area(half_w, w - half_w, y, half_h)
        elif kind == 3:  # middle against outer pitch classes
            a, b = area(0, w, y + third_h, h - 2 * third_h), area(0, w, y, h)
            a, b = a / (h - 2 * third_h), (b - a) / (2 * third_h)
        else:  # middle against the ends in time
            a, b = area(third_w, w - 2 * third_w, y, h), area(0, w, y, h)
            a, b = a / (w - 2 * third_w), (b - a) / (2 * third_w)
        value = np.log((np.maximum(a, 0) + 0.2) / (np.maximum(b, 0) + 0.2))
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)  # Gray code: neighbours differ in one bit
    return out


def pcm(value: bytes | None) -> np.ndarray:
    """Samples of 16-bit little-endian mono PCM; null is empty."""
    return np.frombuffer((value or b"")[: len(value or b"") // 2 * 2], "<i2")


def notes(values: list[float] | None, rate: int = 4000, length: int = 512) -> np.ndarray:
    """A test recording: each number sounds as a note of ``length`` samples whose pitch class follows its size."""
    t = np.arange(length) / rate
    tones = [np.sin(2 * np.pi * PITCH_A * 2 ** (k / 12) * t) * np.hanning(length) for k in range(12)]
    steps = [min(11, int(12 * (np.arctan(8 * v) / np.pi + 0.5))) for v in values or () if v is not None and np.isfinite(v)]
    return (np.concatenate([tones[k] for k in steps]) * 12000).astype(np.int16) if steps else np.zeros(0, np.int16)


def fingerprints(recordings: DataFrame, id_col: str, media_col: str, rate: int = 4000, decode: Callable[..., np.ndarray] = pcm) -> DataFrame:
    """(id, prints array<int>) of each row; ``decode`` turns the media column into samples. Null or short media have no prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                found = [fingerprint(chroma(decode(v), rate)).view(np.int32) for v in s.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "prints"])

    return recordings.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, prints array<int>")


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits of ``a`` and ``b`` where b[i + offset] meets a[i], and the number of shared frames."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo)), hi - lo


def classes(prints: DataFrame, is_query: Column | None = None) -> DataFrame:
    """(node, prints, class_id, n, asked) of each distinct fingerprint of ``prints`` (id, prints): its smallest id, its rows,
    and how many of them are queries. Recordings without prints have no class."""
    asked = F.coalesce(is_query, F.lit(False)) if is_query is not None else F.lit(False)
    found = prints.filter(F.size("prints") > 0).groupBy("prints").agg(F.min("id").alias("class_id"), F.count("*").alias("n"), F.count_if(asked & F.col("id").isNotNull()).alias("asked"))
    return found.withColumn("node", F.monotonically_increasing_id())


def _postings(found: DataFrame) -> DataFrame:
    """(node, at, value, before): a key for each run of equal integers, of the run's integer, the next one's, and the frames between.

    A steady sound is one row, however long it lasts; a recording of one run has its integer alone as
    the key. Two neighbouring runs make a key rare: on random vectors ten times fewer rows meet than
    by single integers, and a recording still meets what differs in up to BIT_ERRORS of its bits.
    ``before`` is what the key before adds to this one, the integer and the frames of the run before; null for the first.
    """
    runs = F.expr("filter(transform(prints, (x, i) -> struct(i as at, x as value)), (r, i) -> i = 0 or r.value <> prints[i - 1])")
    before = "if(i = 0, null, shiftleft(cast(runs[i - 1].value as bigint), 32) + r.at - runs[i - 1].at) as before"
    keys = F.expr(f"if(size(runs) = 1, array(struct(0 as at, xxhash64(runs[0].value) as value, cast(null as bigint) as before)), transform(slice(runs, 1, size(runs) - 1), (r, i) -> struct(r.at as at, xxhash64(r.value, runs[i + 1].value, runs[i + 1].at - r.at) as value, {before})))")
    return found.withColumn("runs", runs).select("node", F.explode(keys).alias("r")).select("node", "r.at", "r.value", "r.before")


def _met(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Postings of queries (q, at, value, before) beside the equal ones of other recordings (node, at, value, before): (q, node, offset).

    Of keys in a row that two recordings share, the first alone meets: the others have the same offset.
    """
    rows = asked.count()
    q = asked.select("q", F.col("at").alias("q_at"), "value", F.col("before").alias("q_before"))
    if rows <= BROADCAST_ROWS:
        met = held.join(F.broadcast(q), "value")
    else:
        salts = held.groupBy("value").count().filter(F.col("count") > HOT).select("value", F.ceil(F.col("count") / HOT).cast("int").alias("salts"))
        salts = cut(salts.join(q.select("value").distinct(), "value", "left_semi"))
        n = F.coalesce("salts", F.lit(1))
        dealt = held.join(salts, "value", "left").withColumn("salt", F.pmod(F.xxhash64("node"), n).cast("int"))
        spread = q.join(salts, "value", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1)))
        met = dealt.drop("salts").join(spread.drop("salts"), ["value", "salt"])
    return met.filter("q <> node and coalesce(before <> q_before, true)").select("q", "node", (F.col("at") - F.col("q_at")).alias("offset"))


def aligned(found: DataFrame) -> DataFrame:
    """(q, node, offset, bit_errors, frames) of the classes that align with a class of queries, at their best offset.

    Equal keys meet by a join and are counted by offset; every offset with one is compared bit by bit.
    """
    asked = cut(_postings(found.filter("asked > 0")).withColumnRenamed("node", "q"))
    votes = _met(asked, _postings(found)).distinct()
    a, b = found.select(F.col("node").alias("q"), F.col("prints").alias("a")), found.select("node", F.col("prints").alias("b"))
    lo, hi = F.greatest(F.lit(0), -F.col("offset")), F.least(F.expr("size(a)"), F.expr("size(b)") - F.col("offset"))
    shorter = F.least(F.expr("size(a)"), F.expr("size(b)"))
    near = (
        votes.join(a, "q").join(b, "node").withColumn("lo", lo).withColumn("frames", hi - F.col("lo"))
        .filter((F.col("frames") >= F.least(F.lit(OVERLAP), shorter)) & (F.col("frames") * 2 >= shorter))
        .withColumn("pairs", F.expr("zip_with(slice(a, lo + 1, frames), slice(b, lo + offset + 1, frames), (x, y) -> bit_count(cast(x ^ y as bigint) & 4294967295))"))
        .withColumn("bit_errors", F.expr("aggregate(pairs, 0, (s, x) -> s + x)") / (32 * F.col("frames")))
        .filter(F.col("bit_errors") <= F.least(F.lit(1.0), F.col("frames") / OVERLAP) * BIT_ERRORS)
    )
    best = near.groupBy("q", "node").agg(F.min(F.struct("bit_errors", "offset", "frames")).alias("best"))
    return best.select("q", "node", "best.offset", "best.bit_errors", "best.frames")


def search(prints: DataFrame, is_query: Column) -> DataFrame:
    """One row for each query row of ``prints`` (id, prints) and each class of recordings that aligns with it.

    (id, match_class, n_recordings, offset, bit_errors, frames): the smallest id of the recordings of
    one fingerprint, how many these are (the query itself doesn't count), and where they align best.
    A query without a match has one row of nulls with n_recordings 0; one without prints has no
    match. Copies are one class, so they never become pairs. Rows with a null id aren't queries; they
    count as recordings. Queries of one id and equal prints are one.
    """
    prints = cut(prints)
    found = cut(classes(prints, is_query))
    queries = prints.filter(is_query & F.col("id").isNotNull()).dropDuplicates(["id", "prints"])
    queries = queries.join(found.filter("asked > 0").select("prints", F.col("node").alias("q"), F.col("n").alias("copies"), F.col("class_id").alias("own")), "prints", "left").drop("prints")
    hits = cut(aligned(found)).join(found.select("node", "class_id", "n"), "node").drop("node")
    other = queries.join(hits, "q").select("id", F.col("class_id").alias("match_class"), F.col("n").alias("n_recordings"), "offset", "bit_errors", "frames")
    lengths = found.filter("asked > 0 and n > 1").select(F.col("node").alias("q"), F.size("prints").alias("frames"))
    same = queries.join(lengths, "q").select("id", F.col("own").alias("match_class"), (F.col("copies") - 1).alias("n_recordings"), F.lit(0).alias("offset"), F.lit(0.0).alias("bit_errors"), "frames")
    none = queries.join(hits.select("q").distinct(), "q", "left_anti").filter("q is null or copies = 1")
    empty = none.select("id", F.lit(None).cast("long").alias("match_class"), F.lit(0).cast("long").alias("n_recordings"), *(F.lit(None).cast(t).alias(c) for c, t in (("offset", "int"), ("bit_errors", "double"), ("frames", "int"))))
    return other.union(same).union(empty)


def summary(found: DataFrame) -> DataFrame:
    """The result of search() by query: (id, n_matches, n_classes, classes_hash, best_class, best_offset, best_bit_errors, best_frames).

    n_matches counts recordings; classes_hash is the exclusive or of the XXH64 of the classes' ids; best:
    fewest bit errors, then the smallest id. Partial sums only: no query's matches meet in one place.
    """
    match = F.col("n_recordings") > 0
    best = F.min(F.when(match, F.struct("bit_errors", "match_class", "offset", "frames"))).alias("best")
    by = found.groupBy("id").agg(F.sum("n_recordings").alias("n_matches"), F.count_if(match).alias("n_classes"), F.bit_xor(F.when(match, F.xxhash64("match_class"))).alias("classes_hash"), best)
    return by.select("id", "n_matches", "n_classes", F.coalesce("classes_hash", F.lit(0)).alias("classes_hash"), F.col("best.match_class").alias("best_class"), F.col("best.offset").alias("best_offset"), F.col("best.bit_errors").alias("best_bit_errors"), F.col("best.frames").alias("best_frames"))


def membership(prints: DataFrame) -> DataFrame:
    """(id, class_id) of every row of ``prints``: the smallest id of its fingerprint; null without prints."""
    found = classes(prints).select("prints", "class_id")
    return prints.join(found, "prints", "left").select("id", "class_id")
