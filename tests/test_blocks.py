"""Cuts, features, deltas and frames against scalar versions and round trips."""

import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunklake.functions import kernels
from chunklake.operators import chunking, codec, similarity, store

SIZES = [0, 1, 100, 4095, 4096, 4097, 16384, 65536, 65537, (3 << 20) + 17]


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def text(n, seed=1):
    r = random.Random(seed)
    words = [bytes(r.choices(b"abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(400)]
    out = bytearray()
    while len(out) < n:
        out += r.choice(words) + b" "
    return bytes(out[:n])


def slow_cut(b):
    if len(b) <= kernels.LEAST:
        return len(b)
    h = 0
    for i in range(kernels.LEAST, min(len(b), kernels.LARGEST)):
        h = (h * 2 + int(kernels.GEAR[b[i]])) % 2**64
        if h >> (kernels.STRICT if i < kernels.NORMAL else kernels.LOOSE) == 0:
            return i + 1
    return min(len(b), kernels.LARGEST)


def test_gear():
    assert int(kernels.GEAR[0]) == 0xDC1B77AE0BF34DAD and int(kernels.GEAR[255]) == 0x9DDBCC9ADADFE798


@pytest.mark.parametrize("make", [noise, text])
def test_cuts_equal_scalar(make):
    data = make(700_000)
    at, want = 0, []
    while at < len(data):
        at += slow_cut(data[at : at + kernels.LARGEST])
        want.append(at)
    assert kernels.cut_points(data) == want


def test_features_equal_scalar():
    for n in (63, 64, 65, 3000):
        data, h, low = noise(n, n), 0, [2**64 - 1] * 3
        for i, c in enumerate(data):
            h = (h * 2 + int(kernels.GEAR[c])) % 2**64
            if i >= 63:
                for k, m in enumerate(kernels.MULTIPLIERS):
                    x = h * m % 2**64
                    low[k] = min(low[k], x ^ x >> 31)
        assert [f % 2**64 for f in kernels.block_features(data)] == low


def contents(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n long, v binary")
    return chunking.contents_of(df, "v", "n")


@pytest.mark.parametrize("make", [noise, text])
def test_round_trip(spark, make):
    raw = contents(spark, [make(n) for n in SIZES])
    blocks = chunking.chunk(raw, payload=True).cache()
    got = chunking.reconstruct(blocks, chunking.new_chunks(blocks).select("chunk_id", "payload"))
    rows = got.collect()
    assert len(rows) == len(SIZES) - 1 and all(r.ok for r in rows)
    mean = blocks.filter("len >= 4096").agg(F.avg("len")).first()[0]
    assert 8 << 10 <= mean <= 40 << 10
    whole = make(SIZES[-1])
    ranges = raw.filter(F.octet_length("content") == len(whole)).select("content_id", F.lit(100_000).cast("long").alias("off"), F.lit(200_000).cast("long").alias("n"))
    part = chunking.read_ranges(store.blocks_of_range(blocks.drop("start"), ranges), blocks.select("chunk_id", "payload").dropDuplicates(["chunk_id"])).first()
    assert bytes(part.content) == whole[100_000:300_000]


def test_shift_costs_little(spark):
    a = text(2 << 20)
    b = a[: 1 << 20] + noise(30) + a[1 << 20 :]
    raw = contents(spark, [a, b])
    results = chunking.put_results(raw, chunking.chunk(raw)).orderBy("new_bytes").collect()
    assert results[0].new_bytes <= 256 << 10 and results[0].hit_rate > 50


def test_corruption_is_seen(spark):
    raw = contents(spark, [text(50_000)])
    blocks = chunking.chunk(raw, payload=True)
    bad = chunking.new_chunks(blocks).select("chunk_id", F.when(F.col("seq") == 0, F.lit(b"x").cast("binary")).otherwise(F.col("payload")).alias("payload"))
    assert not chunking.reconstruct(blocks, bad).first().ok


def test_deltas(spark):
    base = noise(2 << 20)
    near = bytearray(base)
    for i in range(0, len(near), 3000):
        near[i] ^= 0x5A
    raw = contents(spark, [base, bytes(near)])
    blocks = chunking.new_chunks(chunking.chunk(raw, payload=True)).cache()
    first = blocks.filter("ord = 0")
    known = similarity.features(first).withColumn("log_pos", F.lit(1))
    pairs = similarity.candidates(similarity.features(blocks.filter("ord = 1")), known)
    deltas = similarity.encode(pairs, blocks).cache()
    n = blocks.filter("ord = 1").count()
    assert deltas.count() >= 0.8 * n
    assert all(r.ok for r in similarity.decode(deltas, first).select((F.sha2("payload", 256) == F.col("chunk_id")).alias("ok")).collect())
    bases = similarity.set_candidates(similarity.features(blocks))
    assert bases.join(bases.select(F.col("base_id").alias("chunk_id")), "chunk_id").count() == 0


def test_newest_base_only(spark):
    known = spark.createDataFrame([("old", 7, 1), ("new", 7, 2), ("b", 8, 1)], "chunk_id string, f long, log_pos long")
    probe = spark.createDataFrame([("p", 0, 7), ("p", 1, 8)], "chunk_id string, slot int, f long")
    usable = spark.createDataFrame([("old",), ("b",)], "chunk_id string")
    assert similarity.candidates(probe, known).first().base_id == "new"
    assert similarity.candidates(probe, known, usable).first().base_id == "b"


def test_frames(spark):
    rows = [(0, 0, i, f"c{i}", n) for i, n in enumerate([600, 300, 200, 1000, 5, 5])]
    packed = chunking.pack_frames(spark.createDataFrame(rows, "writer int, ord long, seq int, chunk_id string, len long"), 1000)
    assert [r.frame for r in packed.orderBy("seq").collect()] == [0, 0, 0, 1, 2, 2]
    for data in (text(300_000), noise(300_000), b""):
        c, z = kernels.frame_form(data)
        assert (kernels.decompress(z, len(data)) if c else z) == data
    assert kernels.worth_compressing(text(1 << 20)) and not kernels.worth_compressing(noise(1 << 20))
    assert kernels.worth_compressing(noise(900_000) + b"a" * 100_000)
    share = chunking.stored_shares(packed.withColumn("content_id", F.col("chunk_id")), spark.createDataFrame([(0, 0, 1100, 400, 3)], "writer int, frame int, raw_len long, disk long, chunks long"))
    assert {r.content_id: r.stored_disk for r in share.collect()} == {"c0": 568 * 600 // 1100, "c1": 568 * 300 // 1100, "c2": 568 * 200 // 1100}


def test_recompress_is_idempotent(spark):
    data = text(200_000)
    f = spark.createDataFrame([(1, 0, 1, len(data), kernels.compress(data, 1)), (2, 0, 0, 3, b"abc")], "seg int, frame int, codec int, raw_len long, data binary")
    once = codec.recompress(f, f.select("seg")).cache()
    a = once.filter("seg = 1").first()
    assert a.codec == 2 and len(a.data) < len(kernels.compress(data, 1)) and kernels.decompress(bytes(a.data), a.raw_len) == data
    assert sorted(codec.recompress(once, once.select("seg")).collect()) == sorted(once.collect())


def test_recompress_holds_one_frame(spark, monkeypatch):
    """60 MB of raw frames in one batch: the kernel holds a few MB. Frames that stay as they are may even be null."""
    plain = text(1 << 12) * 256
    fast = kernels.compress(plain, 1)
    rows = [(1, i, 1, len(plain), fast) for i in range(60)] + [(1, 60, 2, 9, b"not zstd"), (1, 61, 0, 0, None), (1, 62, None, None, None)]
    f = spark.createDataFrame(rows, "seg int, frame int, codec int, raw_len long, data binary").coalesce(1)
    got = {r.frame: (r.codec, r.raw_len, r.data and bytes(r.data)) for r in codec.recompress(f, f.select("seg").distinct()).collect()}
    best = kernels.compress(plain, 19)
    assert got == {i: (2, len(plain), best) for i in range(60)} | {60: (2, 9, b"not zstd"), 61: (0, 0, None), 62: (None, None, None)}
    kernel = []
    monkeypatch.setattr(type(f), "mapInArrow", lambda self, run, schema: kernel.append(run) or self)
    codec.recompress(f, f.select("seg"))
    columns = list(zip(*(r for r in rows if r[2] == 1), strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], f.columns)
    tracemalloc.start()
    assert sum(b.num_rows for b in kernel[0](iter([batch]))) == 60
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20


def test_frames_are_built_in_order(spark):
    parts = [(w, w * 10 + k // 3, k // 2, k % 2, f"b{w}-{k}", text(3000 + k)[k:]) for w in range(2) for k in range(9)]
    random.Random(1).shuffle(parts)
    d = spark.createDataFrame(parts, "writer int, frame int, ord long, seq int, chunk_id string, payload binary")
    got = codec.build_frames(d.drop("payload"), d.select("chunk_id", "payload")).collect()
    want = {(w, f): b"".join(p[5] for p in sorted(parts, key=lambda p: p[2:4]) if p[:2] == (w, f)) for w, f in {p[:2] for p in parts}}
    assert {(r.writer, r.frame): kernels.decompress(bytes(r.data), r.raw_len) if r.codec else bytes(r.data) for r in got} == want
    assert all(r.raw_len == len(want[r.writer, r.frame]) for r in got)


@pytest.mark.parametrize("level", [0, 1, 4, 6, 9])
def test_zlib_streams(level):
    plain = b"blob 5\0" + text(50_000)
    z = zlib.compress(plain, level)
    found = kernels.unzlib(z)
    assert found and found[0] == plain and zlib.compress(plain, found[1]) == z
    assert kernels.unzlib(z + b"junk") is None and kernels.unzlib(b"\x78\x9d" + z[2:]) is None and kernels.unzlib(z[:-9]) is None


def test_zlib_columns(spark):
    z = zlib.compress(text(20_000), 6)
    d = spark.createDataFrame([(1, z), (2, b"plain"), (3, None)], "n int, v binary").withColumn("f", codec.unzlib("v"))
    got = {r.n: r for r in d.select("n", "v", "f", codec.worth_compressing("v").alias("w")).collect()}
    assert got[1].f.level is not None and got[2].f.level is None and got[3].w
    again = d.filter("f.level is not null").select("v", codec.rezlib("f.plain", "f.level").alias("z")).first()
    assert again.v == again.z == z


def test_rebase_candidates(spark):
    index = spark.createDataFrame([("old", False, None), ("other", False, None), ("d", True, "old")], "chunk_id string, is_delta boolean, base_id string")
    orphans = spark.createDataFrame([("old",)], "base_id string")
    known = spark.createDataFrame([("old", 0, 5, 9), ("other", 0, 6, 1), ("d", 0, 5, 0), ("d", 1, 6, 0)], "chunk_id string, slot int, f long, log_pos long")
    live = spark.createDataFrame([("other",), ("d",)], "chunk_id string")
    assert [tuple(r) for r in similarity.rebase_candidates(orphans, index, known, live).collect()] == [("d", "other")]


def test_gc_of_everything(spark):
    index = spark.createDataFrame([("a", 0, 0, 10, False, None), ("b", 0, 0, 10, True, "a"), ("c", 1, 0, 5, False, None)], "chunk_id string, seg int, frame_off long, size long, is_delta boolean, base_id string")
    frames = spark.createDataFrame([(0, 0, 1, 20, 9), (1, 0, 1, 5, 4)], "seg int, frame_off long, codec int, raw_len long, comp_len long")
    recipes = spark.createDataFrame([], "chunk_id string")
    live = store.mark_live(index, recipes)
    assert [r.chunk_id for r in live.collect()] == ["a"]  # base of a dead delta
    assert {r.chunk_id: r.fate for r in store.gc_plan(index, frames, recipes, 0.0).collect()} == {"a": "move", "b": "drop", "c": "drop"}
    assert store.rebase_worth(spark.createDataFrame([("a", 100, 40)], "base_id string, base_size long, delta_bytes long"), spark.createDataFrame([("a", 100)], "base_id string, len long")).first().apply
