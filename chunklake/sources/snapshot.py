"""Versioned tables: every change writes new Parquet folders, and one pointer makes them visible together."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Tables under ``root``, any folder that Spark can write: ``root/<table>/<id>`` and ``root/_versions/<n>``.

    Readers see the newest complete version. A version is a one-row text file whose name is its
    number; writing it is the last step, so an aborted change stays invisible. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._known: dict[int, dict[str, list[str]]] = {}  # a published version never changes

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, jvm

    def versions(self) -> list[int]:
        fs, path, _ = self._fs()
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def tables(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of each table in a version, the newest by default."""
        known = self.versions()
        if not known:
            return {}
        at = known[-1] if version is None else version
        if at not in self._known:
            text = self.spark.read.text(f"{self.root}/_versions/{at}", wholetext=True).first()
            self._known[at] = json.loads(text.value)
        return {name: list(folders) for name, folders in self._known[at].items()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{folder}" for folder in self.tables(version)[table]))

    def by_folder(self, table: str) -> DataFrame:
        """The newest rows of a table with ``folder``, the one that holds them."""
        folder = F.regexp_extract(F.col("_metadata.file_path"), f"({table}/[0-9a-f]{{32}})/[^/]*$", 1)
        return self.read(table).select("*", folder.alias("folder"))

    def publish(self, changed: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, kept: dict[str, list[str]] | None = None) -> int:
        """Write tables anew (``changed``) or more rows of them (``added``); these and all others are the next version.

        Of a changed table the folders in ``kept`` stay in the next version as they are.
        """
        now = self.tables()
        for name, df in [*(changed or {}).items(), *(added or {}).items()]:
            folder = f"{name}/{uuid4().hex}"
            df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            now[name] = [*(now.get(name, []) if name in (added or {}) else (kept or {}).get(name, [])), folder]
        n = (self.versions() or [0])[-1] + 1
        fs, path, jvm = self._fs()
        tmp = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_tmp-{uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        fs.mkdirs(path)
        if not fs.rename(tmp, jvm.org.apache.hadoop.fs.Path(path, str(n))):
            raise RuntimeError(f"version {n} was published by another writer")
        return n

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete all versions but the newest, and the folders that only they name; how many folders went.

        Readers of a deleted version fail, so keep as many as readers may hold. Folders of a change
        that never was published go too; there is one writer, so no change is under way.
        """
        fs, path, jvm = self._fs()
        known = self.versions()
        kept = known[-max(1, keep_versions) :]
        named = {folder for v in kept for folders in self.tables(v).values() for folder in folders}
        for v in set(known) - set(kept):  # versions first: what is left always names folders that exist
            fs.delete(jvm.org.apache.hadoop.fs.Path(path, str(v)), False)
        gone = 0
        for table in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.root)):
            name = table.getPath().getName()
            if table.isDirectory() and not name.startswith("_"):
                for f in fs.listStatus(table.getPath()):
                    if f"{name}/{f.getPath().getName()}" not in named:
                        gone += bool(fs.delete(f.getPath(), True))
        return gone
