"""Files, packages, versions and streams."""

import json

import pytest
from pyspark.sql import functions as F

from chunklake.operators import chunking
from chunklake.sources import files
from chunklake.sources.snapshot import Snapshots
from chunklake.streaming import jobs


def test_scan_and_extract(spark, tmp_path):
    for k in range(5):
        p = tmp_path / "in" / f"d{k % 2}" / f"f{k}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (k % 3) * 1000)
    got = files.scan(spark, str(tmp_path / "in"), with_empty=True).orderBy("rel_path").collect()
    assert [r.rel_path for r in got] == ["d0/f0.txt", "d0/f2.txt", "d0/f4.txt", "d1/f1.txt", "d1/f3.txt"]
    assert files.folder_size(spark, str(tmp_path / "in")).first()[:] == (3, 4000)
    raw = files.scan(spark, str(tmp_path / "in"), with_empty=True)
    e = raw.select(F.monotonically_increasing_id().alias("ord"), F.col("content_id").alias("id"), F.lit("g").alias("group"), "rel_path", F.lit(0o755).alias("mode"))
    none = spark.createDataFrame([], "target string")
    plan = files.extract_plan(e, none, str(tmp_path / "out"))
    done = files.extract(plan, raw.select("content_id", "content").dropDuplicates(["content_id"])).collect()
    assert len(done) == 5 and all(r.ok for r in done)
    assert (tmp_path / "out/g/d0/f2.txt").read_bytes() == b"x" * 2000 and (tmp_path / "out/g/d0/f2.txt").stat().st_mode & 0o777 == 0o755
    again = files.extract_plan(e, plan.select("target"), str(tmp_path / "out"))
    assert {r.status for r in again.collect()} == {"exists"}
    assert {r.status for r in files.extract_plan(e, plan.select("target"), str(tmp_path / "out"), force=True).collect()} == {"write"}
    for group, path in (("g", "../../escaped.txt"), ("g", "/etc/x"), ("..", "x"), ("g", "a/../../../x"), ("g", "..\\x")):
        bad = files.extract_plan(e.limit(1).withColumns({"group": F.lit(group), "rel_path": F.lit(path)}), none, str(tmp_path / "out"))
        assert [r.status for r in bad.collect()] == ["refused"] and files.extract(bad, raw.select("content_id", "content")).count() == 0
    fine = files.extract_plan(e.limit(1).withColumn("rel_path", F.lit("a..b/...c/d..")), none, str(tmp_path / "out"))
    assert fine.first().status == "write"


def test_manifest(spark, tmp_path):
    rows = [{"ord": 1, "id": "a", "name": "n", "group": "g", "rel_path": "x/n", "unknown": 5}, {"ord": 2, "id": "b", "name": "t", "rel_path": "t", "folder": "/.Trash-1/", "path": "/.Trash-1/t"}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, rows)))
    got = files.read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert [(r.path, r.folder, len(r.uid)) for r in got] == [("/arquivos/g/x/n", "/arquivos/g", 16)]
    (tmp_path / "torn.json").write_text(json.dumps(rows[0]) + '\n{"ord": 2, "id": "')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_manifest(spark, str(tmp_path / "torn.json")).collect()


def test_manifest_round_trip(spark, tmp_path, sf):
    from chunklake.plans import fixtures

    e = fixtures.entries(spark, sf).select("ord", "uid", "id", "name", "group", "rel_path", "folder", "path", "size", "storage")
    files.write_manifest(e, str(tmp_path / "m"))
    back = files.read_manifest(spark, str(tmp_path / "m")).select(e.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, e.collect()))


def test_packages(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 4} " * 900) for k in range(6)], "n long, t string")
    raw = chunking.contents_of(docs, "t", "n")
    e = docs.select(F.col("n").alias("ord"), F.concat(F.lit("u"), "n").alias("uid"), F.sha2(F.col("t").cast("binary"), 256).alias("id"), F.concat(F.lit("f"), "n").alias("rel_path"), F.lit("g").alias("group"), F.lit("/arquivos/g").alias("folder"), F.concat(F.lit("/arquivos/g/f"), "n").alias("path"))
    files.export_group(e, chunking.chunk(raw, payload=True), "g", str(tmp_path / "b"))
    members, blocks = files.open_bundle(spark, str(tmp_path / "b"))
    whole = chunking.reconstruct(blocks, chunking.new_chunks(blocks).select("chunk_id", "payload"))
    check = members.select(F.col("rel_path").alias("name"), F.col("id").alias("sha256"))
    assert files.bundle_errors(check, whole).count() == 0
    assert files.bundle_errors(check, whole.limit(1)).count() > 0
    merged = files.import_group(e, members, "other")
    assert merged.count() == 12 and files.import_group(merged, members, "other").count() == 12


def test_versions(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.tables() == {}
    s.publish({"a": spark.range(3), "b": spark.range(1)})
    s.publish({"a": spark.range(5)}, added={"b": spark.range(2)})
    assert (s.read("a").count(), s.read("b").count(), s.read("a", 1).count(), s.versions()) == (5, 3, 3, [1, 2])


def test_ingest_stream(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    s = Snapshots(spark, str(tmp_path / "s"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        jobs.ingest(stream, s, str(tmp_path / "c")).awaitTermination()
    distinct = docs.select(F.sha2("text", 256).alias("content_id")).distinct()
    whole = chunking.reconstruct(s.read("recipes"), s.read("blocks").select("chunk_id", "payload"))
    assert whole.filter("ok").count() == distinct.count() == whole.count()
    assert s.read("blocks").groupBy("chunk_id").count().filter("count > 1").count() == 0


EVENTS = [
    ("a", 1, "create", 0), ("a", 2, "write", 10), ("a", 3, "flush", 0), ("a", 4, "write", 20), ("a", 5, "release", 0),
    ("b", 1, "create", 0), ("b", 2, "write", 5), ("b", 3, "delete", 0), ("b", 4, "release", 0),
    ("c", 1, "write", 7), ("c", 2, "flush", 0), ("d", 1, "create", 0), ("d", 2, "release", 0),
    ("a", 6, "write", 3), ("a", 7, "truncate", 2), ("a", 8, "release", 0), ("e", 1, "release", 0),
]
FINISHED = [("a", 2), ("a", 20), ("d", 0)]


def test_finished_writes(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, jobs.EVENTS)
    assert sorted(tuple(r) for r in jobs.finished_writes_table(df).collect()) == FINISHED


def test_finished_writes_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, jobs.EVENTS)
    for k in range(2):
        df.filter((F.col("seq") > 2) == bool(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = jobs.finished_writes(stream).writeStream.format("memory").queryName("finished").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert sorted(tuple(r) for r in spark.table("finished").collect()) == FINISHED


def test_windows_stream_equals_table(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = jobs.windows(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, jobs.windows(events).collect()))


def test_may_work(spark):
    m = spark.createDataFrame([(700, 0.1, 900, False), (500, 0.1, 900, False), (700, 9.0, 900, False), (700, 0.1, 100, False), (700, 0.1, 900, True)], "idle_seconds long, load1 double, free_mb long, open_batch boolean")
    assert [r[0] for r in m.select(jobs.may_work(m, 4)).collect()] == [True, False, False, False, False]
