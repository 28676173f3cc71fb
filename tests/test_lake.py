"""A lake from add to gc."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chunklake.lake import Lake
from chunklake.operators.catalog import CatalogError


@pytest.fixture
def lake(spark, tmp_path):
    out = Lake(spark, str(tmp_path / "lake"))
    out.init()
    return out


def files_of(spark, pairs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in pairs], "rel_path string, content binary")


def test_life(spark, lake, tmp_path):
    base = random.Random(1).randbytes(300_000)
    near = bytearray(base)
    for i in range(0, len(near), 20_000):
        near[i] ^= 0x5A
    lake.add(files_of(spark, [("a", base), ("d/b", base), ("empty", b""), ("t", b"text " * 30_000)]), "one")
    assert lake.stats().first().files == 4 and lake.verify().count() == 0
    blocks = lake._read("blocks").count()
    lake.add(files_of(spark, [("again", base)]), "two")
    assert lake._read("blocks").count() == blocks  # nothing new
    lake.add(files_of(spark, [("near", bytes(near))]), "three")
    deltas = lake._read("blocks").filter("base_id is not null")
    assert deltas.count() > 0 and lake.verify().count() == 0
    assert deltas.join(deltas.select(F.col("base_id").alias("chunk_id")), "chunk_id", "left_semi").count() == 0
    cid = lake.match("near").first().id
    assert bytes(lake.read(spark.createDataFrame([(cid, 70_000, 90_000)], "content_id string, off long, n long")).first().content) == bytes(near[70_000:160_000])
    lake.export_group("three", str(tmp_path / "bundle"))
    lake.remove(lake.entries().filter("`group` in ('one', 'three')").select("uid"))
    assert lake.stats().first().files == 1 and lake.garbage().first().chunks > 0
    lake.gc()
    lake.gc()
    assert lake.garbage().first().chunks == 0 and lake.verify().count() == 0
    lake.import_group(str(tmp_path / "bundle"), "back")
    assert lake.verify().count() == 0 and {r.path for r in lake.entries().collect()} == {"/arquivos/two/again", "/arquivos/back/near"}
    lake.add(files_of(spark, [("again", b"other")]), "two")  # takes the place of the old one
    assert lake.entries().filter("path = '/arquivos/two/again'").first().size == 5
    assert {r.path for r in lake.tree().collect()} >= {"/", "/arquivos", "/arquivos/one", "/arquivos/back"}


def disk(lake):
    top = Path(lake.snapshots.root)
    return sum(f.stat().st_size for f in (top / "blocks").rglob("*.parquet"))


def test_gc_frees_the_disk(spark, lake):
    """After remove, gc and vacuum the files of dead blocks are gone; folders without any stay as they are."""
    rng = random.Random(4)
    kept = files_of(spark, [("k", rng.randbytes(200_000))])
    lake.add(kept, "kept")
    folders = set(lake.snapshots.tables()["blocks"])
    lake.add(files_of(spark, [("a", rng.randbytes(300_000)), ("b", rng.randbytes(100_000))]), "mixed")
    before = disk(lake)
    lake.remove(lake.entries().filter("name = 'a'").select("uid"))
    assert lake.gc(least_share=0.9) == 0  # three quarters of the folder are dead
    version = lake.snapshots.versions()[-1]
    assert lake.gc() > 290_000 and folders <= set(lake.snapshots.tables()["blocks"])
    assert lake.verify().count() == 0 and disk(lake) > before  # the old version is still there
    assert lake.vacuum() > 0 and disk(lake) < before - 250_000
    assert lake.snapshots.versions() == [version + 1] and lake.verify().count() == 0
    after = disk(lake)
    assert lake.gc() == 0 and lake.vacuum() == 0 and disk(lake) == after and lake.stats().first().files == 2
    lake.add(kept, "again")
    assert lake.verify().count() == 0


def test_damaged_recipes_stop_gc(spark, lake):
    lake.add(files_of(spark, [("a", random.Random(5).randbytes(200_000)), ("empty", b"")]), "g")
    lake.remove(lake.entries().filter("name = 'empty'").select("uid"))
    good = lake._read("recipes")
    assert lake.gc() == 0
    for bad in (good.filter("seq <> 1"), good.limit(0), good.withColumn("chunk_id", F.when(F.col("seq") == 0, "none").otherwise(F.col("chunk_id"))), good.withColumn("len", F.col("len") + 1)):
        lake.snapshots.publish({"recipes": bad})
        with pytest.raises(CatalogError, match="damaged"):
            lake.gc()
        lake.snapshots.publish({"recipes": good})
    assert lake.gc() == 0 and lake.verify().count() == 0


def test_entries_of_an_add(spark, lake, tmp_path):
    text = b"".join(b"%d and more words\n" % (i * i) for i in range(4000))
    rows = [(f"d/{i:03}", bytearray(text if i % 2 else text[: 10_000 + i]), 0o755 if i == 3 else None) for i in range(20)]
    lake.add(spark.createDataFrame(rows[::-1], "rel_path string, content binary, mode int").repartition(5), "g")
    got = lake.entries().orderBy("ord").collect()
    assert [r.rel_path for r in got] == [r[0] for r in rows] and [r.ord for r in got] == list(range(20))
    assert got[3].mode == 0o755 and got[4].mode == 0o644
    lake.add(spark.createDataFrame(rows[1:2], "rel_path string, content binary, mode int"), "h")
    assert lake.entries().filter("`group` = 'h'").first().hit_rate == 100.0
    for path in ("../x", "/x", "a/../../x", "..", "C:\\x"):
        with pytest.raises(ValueError, match="leaves"):
            lake.add(files_of(spark, [(path, b"x")]), "g")
    lake.export_group("h", str(tmp_path / "bad"))
    members = spark.read.parquet(str(tmp_path / "bad/entries")).withColumn("rel_path", F.lit("../../escaped"))
    members.write.parquet(str(tmp_path / "worse/entries"))
    spark.read.parquet(str(tmp_path / "bad/blocks")).write.parquet(str(tmp_path / "worse/blocks"))
    with pytest.raises(ValueError, match="leave"):
        lake.import_group(str(tmp_path / "worse"), "in")
    cid = got[1].id
    read = lake.read(spark.createDataFrame([(cid, 5, 9_000)], "content_id string, off long, n long"))
    assert bytes(read.first().content) == text[5:9_005]
    scans = read._jdf.queryExecution().executedPlan().toString()
    assert "In(chunk_id" in scans or "EqualTo(chunk_id" in scans


def test_rebase(spark, lake):
    base = random.Random(3).randbytes(20_000)
    near = bytearray(base)
    near[9_000] ^= 1
    lake.add(files_of(spark, [("a", base)]), "one")
    lake.add(files_of(spark, [("b", bytes(near))]), "two")
    lake.remove(lake.match("a").filter("name = 'a'").select("uid"))
    lake.gc()
    before = lake._read("blocks").agg(F.sum(F.octet_length("data"))).first()[0]
    assert lake._read("blocks").filter("base_id is not null").count() == 1  # the base stays for it
    lake.rebase()
    lake.gc()
    after = lake._read("blocks").agg(F.sum(F.octet_length("data"))).first()[0]
    assert after < before and lake._read("blocks").filter("base_id is not null").count() == 0
    assert lake.verify().count() == 0 and lake.garbage().first().chunks == 0


def test_maintenance(spark, lake):
    base = random.Random(2).randbytes(60_000)
    near = bytearray(base)
    for i in range(0, len(near), 4_000):
        near[i] ^= 0x5A
    text = b"".join(b"%d lines of words\n" % (i * i) for i in range(9000))
    lake.add(files_of(spark, [("a", base), ("t", text)]), "one")
    lake.snapshots.publish({"features": lake._read("features").limit(0)})  # as if it had been added without features
    lake.add(files_of(spark, [("b", bytes(near))]), "one")
    size = lake._read("blocks").agg(F.sum(F.octet_length("data"))).first()[0]
    lake.optimize()
    smaller = lake._read("blocks").agg(F.sum(F.octet_length("data"))).first()[0]
    assert smaller <= 0.75 * size and lake.verify().count() == 0
    lake.recompress()
    assert lake._read("blocks").agg(F.sum(F.octet_length("data"))).first()[0] <= smaller and lake.verify().count() == 0
    assert lake._read("blocks").filter("codec = 1").count() == 0
    lake.create_folder("/x/y")
    lake.move_entry(lake.match("t").first().uid, "/x/y")
    lake.rename_folder("/x", "/z")
    assert lake.match("t").first().path == "/z/y/t"
    lake.delete_folder("/z/y")
    assert lake.match("t").first().path == "/z/t"
    assert lake.info().count() == 3 and lake.package_report().count() == 1


def test_codebooks(spark, lake):
    lake.add_codebook("vault", 10)
    lake.add_codebook("spare", 5)
    lake.add(files_of(spark, [("a", b"x")]), "g", codebook="/codebooks/spare.codebook")
    for name in ("vault", "spare"):
        with pytest.raises(CatalogError):
            lake.remove_codebook(name)
    with pytest.raises(CatalogError):
        lake.use_codebook("none")
    assert [r.codebook for r in lake.codebook_stats().collect()] == ["spare"]
    lake.use_codebook("spare")
    lake.remove_codebook("vault")
    assert [r.name for r in lake._read("codebooks").collect()] == ["spare"]
