"""Known totals, folders and merges."""

import pytest
from pyspark.sql import functions as F

from chunklake.functions import scalars
from chunklake.operators import catalog, reports, search

#: id, size, stored size, pack file, codebook, hit rate
ROWS = [("c7", 7300, 911, "c7.pack", "prose", 12.5), ("c7", 7300, 911, "c7.pack", "prose", 12.5), ("c7", 7300, 911, "c7.pack", "prose", 12.5), ("d2", 64, 91, "d2.pack", "prose", 0.0), ("e5", 20_480, 4_097, "e5.pack", "tables", 61.0), ("f1", 333, 350, "f1.pack", "", 0.0)]


def totals(rows):
    """files, distinct contents, bytes, bytes saved by copies, bytes stored."""
    once = {r[0]: r for r in rows}.values()
    return len(rows), len(once), sum(r[1] for r in rows), sum(r[1] for r in rows) - sum(r[1] for r in once), sum(r[2] for r in once)


def entries(spark, rows):
    full = [(i, f"u{i}", *r[:1], f"n{i}", "g", f"n{i}", "/arquivos/g", f"/arquivos/g/n{i}", r[1], r[3], r[2], "", r[4], r[5]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "ord long, uid string, id string, name string, `group` string, rel_path string, folder string, path string, size long, pack_file string, stored_size long, storage string, codebook string, hit_rate double")


def test_human_sizes(spark):
    units = ["B", "KB", "MB", "GB"]
    sizes = [0, 1, 999, 1023, 1024, 3000, 70_000, 1 << 20, 7_654_321, (1 << 30) + 1, 5 << 32]
    want = {}
    for n in sizes:
        k = next(k for k in range(4) if n < 1 << 10 * (k + 1) or k == 3)
        want[n] = f"{n} B" if k == 0 else f"{n / (1 << 10 * k):.1f} {units[k]}"
    got = spark.createDataFrame([(k,) for k in want], "n long").select("n", scalars.human_size(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == want


def test_stats(spark):
    r = reports.stats(entries(spark, ROWS)).first()
    assert (r.files, r.unique_contents, r.original_bytes, r.dedup_saved_bytes, r.stored_bytes) == totals(ROWS)
    r = reports.stats(entries(spark, ROWS).limit(0)).first()
    assert (r.files, r.original_bytes, r.stored_bytes, r.avg_ratio) == (0, 0, 0, 0.0)


def test_codebooks(spark):
    books = spark.createDataFrame([("prose", 77, True)], "name string, size long, is_default boolean")
    got = {r.codebook: r for r in reports.codebook_stats(entries(spark, ROWS), books).collect()}
    assert set(got) == {"prose", "tables", ""} and got["prose"].db_size == 77
    for name, r in got.items():
        files, unique, size, _, stored = totals(own := [x for x in ROWS if x[4] == name])
        assert (r.members, r.unique_contents, r.original_bytes, r.stored_bytes) == (files, unique, size, stored)
        assert r.saved_bytes == size - stored and (name == "prose" or r.avg_hit == own[0][5])
    assert reports.codebook_stats(entries(spark, ROWS).limit(0), books).count() == 0


def test_match(spark):
    rows = [(0, "0123cafe89ab4567", "harbour map.svg", "atlas", "north/harbour map.svg"), (1, "99ee00ff11aa22bb", "harbour map old.svg", "atlas-archive", "harbour map old.svg")]
    e = spark.createDataFrame(rows, "ord long, id string, name string, `group` string, rel_path string")
    assert [search.match(e, t).count() for t in ("harbour map.svg", "0123CAFE", "atlas", "lighthouse", "")] == [1, 1, 2, 0, 2]
    assert [r["rank"] for r in search.match(e, "atlas").collect()] == [0, 1]


def test_grep_cuts_by_bytes(spark):
    t = spark.createDataFrame([(1, "é" * 200 + "X"), (2, "x\r\nno\nX\n"), (3, None)], "ord long, text string")
    got = {(r.ord, r.line_no): r.line for r in search.grep(t, "x").collect()}
    assert got == {(1, 0): "é" * 150 + "…", (2, 0): "x", (2, 2): "X"}


@pytest.mark.parametrize(("folder", "rel", "want"), [("/", "a/b.txt", "/a/b.txt"), ("/x", "b.txt", "/x/b.txt"), ("/x/a", "a/b.txt", "/x//a/b.txt"), ("/x", "a/b.txt", "/x/a/b.txt")])
def test_canonical_path(spark, folder, rel, want):
    assert spark.range(1).select(scalars.canonical_path(F.lit(folder), F.lit(rel))).first()[0] == want


def test_folders_and_modes(spark):
    one = spark.range(1)
    for raw, want in {" a//b/ ": "/a/b", "/a/../c/./d": "/c/d", "": "/", "..": "/"}.items():
        assert one.select(scalars.normal_folder(F.lit(raw))).first()[0] == want
    assert one.select(scalars.display_mode(F.lit(0o600)), scalars.display_mode(F.lit(0o701))).first()[:] == (0o644, 0o755)
    assert one.select(scalars.parse_hit_rate(F.lit("x\n  Hit Rate: 93.5%\nHit Rate: 1"))).first()[0] == 93.5
    assert one.select(scalars.zlib_header(F.lit(b"\x78\x9c\x00")), scalars.zlib_header(F.lit(b"\x78\x9d"))).first()[:] == (True, False)
    flags = scalars.pack_flags(F.lit(True), F.lit(""), F.lit("b"))
    assert one.select(flags).first()[0] == ["--fast", "--codebook=b"]
    assert one.select(scalars.last_line(F.lit("a\nb\n\n"))).first()[0] == "b"


def test_changes(spark):
    folders = spark.createDataFrame([("/",), ("/a",), ("/a/b",), ("/ab",)], "path string")
    e = spark.createDataFrame([(1, "u1", "x", "g", False, "/a/b", "/a/b/d/x"), (2, "u2", "y", "g", False, "/ab", "/ab/y")], "ord long, uid string, name string, `group` string, is_dir boolean, folder string, path string")
    f, moved = catalog.rename_folder(folders, e, "/a", "/z")
    assert {r.path for r in f.collect()} == {"/", "/z", "/z/b", "/ab"}
    assert {r.path for r in moved.collect()} == {"/z/b/d/x", "/ab/y"}
    with pytest.raises(catalog.CatalogError):
        catalog.delete_folder(folders, e, "/a")
    _, up = catalog.delete_folder(folders, e, "/a/b")
    assert up.filter("ord = 1").first().path == "/a/x"
    assert catalog.move_entry(e, folders, "u1", "/").filter("ord = 1").first().path == "/d/x"
    with pytest.raises(catalog.CatalogError):
        catalog.move_entry(e, folders, "u1", "/none")
    with pytest.raises(catalog.CatalogError):
        catalog.create_folder(folders, "/a/")
    new = catalog.rename_entry(e, "/ab/y", "/arquivos/pkg/y2").filter("ord = 2").first()
    assert (new.name, new.folder, new["group"], new.is_dir) == ("y2", "/arquivos/pkg", "pkg", True)
    with pytest.raises(catalog.CatalogError):
        catalog.rename_entry(e, "/ab/y", "/a/b/d/x")


def test_merge_truth_table(spark):
    disk = spark.createDataFrame([(1, "both", "d"), (2, "gone", "d"), (3, "clean", "d"), (4, "new_on_disk", "d")], "ord long, uid string, name string")
    local = spark.createDataFrame([(1, "both", "l", True, False), (2, "gone", "l", True, True), (3, "clean", "l", False, False), (5, "mine", "l", True, False), (6, "lost", "l", False, False)], "ord long, uid string, name string, is_dirty boolean, is_deleted boolean")
    got = [(r.uid, r.name) for r in catalog.merge_entries(disk, local).collect()]
    assert got == [("both", "l"), ("clean", "d"), ("new_on_disk", "d"), ("mine", "l")]
