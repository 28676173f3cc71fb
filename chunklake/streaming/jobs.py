"""Continuous ingest, pending writes, and idle detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chunklake.operators import chunking
from chunklake.sources.snapshot import Snapshots


def idle_periods(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """(start, end, events): runs of activity; between the end of one, a gap after its last event, and the next the store
    is idle. Works on streams (with a watermark) and tables alike.

    A table's events are first summed up by windows of one gap, in which no two are a gap apart; runs
    come from these sums, so one task sees a row for each gap of time with an event, not the events.
    """
    if not events.isStreaming:
        by = events.groupBy(F.window("ts", gap).alias("w")).agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n"))
        order = Window.orderBy("low")
        after = F.expr(f"lag(high) over (order by low) + interval {gap}")
        run = by.withColumn("opens", (after.isNull() | (F.col("low") >= after)).cast("int")).withColumn("run", F.sum("opens").over(order))
        return run.groupBy("run").agg(F.min("low").alias("start"), F.max("high").alias("last"), F.sum("n").alias("events")).select("start", F.expr(f"last + interval {gap}").alias("end"), "events")
    out = events.groupBy(F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def idle_periods_by(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """The same by key over a table: (key, start, last, events), from gaps between neighbours."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    at, before = (F.unix_micros(t.cast("timestamp")) for t in (F.col("ts"), F.lag("ts").over(order)))
    opens = (before.isNull() | (at - before >= gap_seconds * 1_000_000)).cast("int")
    run = events.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(key, "run").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("events"))


def may_work(metrics: DataFrame, cpus: int, quiet_seconds: int = 600, load: float = 0.3, free_mb: int = 768) -> Column:
    """Whether maintenance may run, from a row of metrics (idle_seconds, load1, free_mb, open_batch)."""
    return (F.col("idle_seconds") >= quiet_seconds) & (F.col("load1") <= load * cpus) & (F.col("free_mb") >= free_mb) & ~F.col("open_batch")


def windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: events and their mean value by type in windows of event time, late ones up to ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def ingest(stream: DataFrame, snapshots: Snapshots, checkpoint: str, value: str = "text", order: str = "doc_id", every: str | None = None) -> StreamingQuery:
    """Store the contents of a stream batch by batch: blocks, then recipes, then one pointer.

    A batch that is run again after a failure finds its number in the ``batches`` table and is left out.
    """

    def store(batch: DataFrame, number: int) -> None:
        known = snapshots.tables()
        spark = batch.sparkSession
        if "batches" in known and not snapshots.read("batches").filter(F.col("batch") == number).isEmpty():
            return
        contents = chunking.contents_of(batch, value, order)
        if "recipes" in known:
            contents = contents.join(snapshots.read("recipes").select("content_id"), "content_id", "left_anti")
        chunks = chunking.chunk(contents, payload=True).persist()
        try:
            index = snapshots.read("blocks") if "blocks" in known else None
            blocks = chunking.new_chunks(chunks, index).select("chunk_id", "len", "payload")
            recipes = chunks.select("content_id", "ord", "seq", "chunk_id", "start", "len")
            done = spark.createDataFrame([(number,)], "batch long")
            snapshots.publish(added={"blocks": blocks, "recipes": recipes, "batches": done})
        finally:
            chunks.unpersist()

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


#: Events of a file handle. A rename comes as a delete of the old path and a create of the new one.
EVENTS = "path string, seq long, kind string, size long"


class _Pending(StatefulProcessor):
    """Of each path: what was written, until the handle is released; a path deleted before that is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("pending", "size long, orphan boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        size, orphan = self._state.get() if self._state.exists() else (0, False)
        done: list[tuple] = []
        is_open = self._state.exists()
        for kind, n in zip(events["kind"], events["size"], strict=True):
            if kind == "create":
                size, orphan, is_open = 0, False, True
            elif kind == "write":
                size, is_open = max(size, int(n)), True
            elif kind == "truncate":
                size, is_open = int(n), True
            elif kind == "delete":
                orphan = True
            elif kind == "release" and is_open:
                if not orphan:
                    done.append((key[0], size))
                size, orphan, is_open = 0, False, False
        if is_open:
            self._state.update((size, orphan))
        elif self._state.exists():
            self._state.clear()
        yield pd.DataFrame(done, columns=["path", "size"])

    def close(self) -> None:
        pass


def finished_writes(events: DataFrame) -> DataFrame:
    """(path, size) of each file whose handle was released: flushes don't end a write, deleted files don't count."""
    return events.groupBy("path").transformWithStateInPandas(_Pending(), "path string, size long", "Append", "None")


def finished_writes_table(events: DataFrame) -> DataFrame:
    """The same over a table of events, in windows: a write is what lies between two releases of a path."""
    order = Window.partitionBy("path").orderBy("seq")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    run = events.withColumn("run", F.coalesce(F.sum((F.col("kind") == "release").cast("int")).over(past), F.lit(0)))
    changes = F.struct("seq", "kind", "size")
    parts = run.groupBy("path", "run").agg(F.array_sort(F.collect_list(changes)).alias("e"))

    def step(s: Column, x: Column) -> Column:
        size = F.when(x["kind"] == "create", 0).when(x["kind"] == "write", F.greatest(s["size"], x["size"])).when(x["kind"] == "truncate", x["size"]).otherwise(s["size"])
        orphan = F.when(x["kind"] == "create", False).otherwise(s["orphan"] | (x["kind"] == "delete"))
        is_open = s["open"] | x["kind"].isin("create", "write", "truncate")
        return F.struct(size.cast("long").alias("size"), orphan.alias("orphan"), is_open.alias("open"), (x["kind"] == "release").alias("released"))

    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(False).alias("orphan"), F.lit(False).alias("open"), F.lit(False).alias("released"))
    end = parts.select("path", F.aggregate("e", start, step).alias("s"))
    return end.filter("s.released and s.open and not s.orphan").select("path", F.col("s.size").alias("size"))

