"""Structured Streaming forms: raw records to events, delivery by micro-batch, dedup, stateful drift detection."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions import backoff
from ..model import OUTBOX, TableMapping
from ..operators import binlog, delivery, mapping, outbox, wal2json
from ..operators.sinks import SinkRegistry


def raw_records(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of text lines (column raw) from a folder."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("value").alias("raw"))


def message_events(raw: DataFrame, version: str = "V2") -> DataFrame:
    return mapping.events_from_messages(wal2json.messages(wal2json.decode(raw, version)))


def row_events(raw: DataFrame, rules: tuple[TableMapping, ...], version: str = "V2", serializer: str = "json") -> DataFrame:
    return mapping.apply(wal2json.row_changes(wal2json.decode(raw, version)), rules, serializer)


def start_delivery(events: DataFrame, registry: SinkRegistry, checkpoint: str, outcome_path: str, dead_letter: Callable[[dict, Exception], None] | None = None, *, back_off: backoff.BackOff = backoff.PUBLISH, max_attempts: int = delivery.MAX_ATTEMPTS, trigger: dict | None = None) -> StreamingQuery:
    """Publish a stream.  A batch's outcome rows are written under its number (so a repeated batch replaces them); a held
    record makes the batch fail, and it comes again when the query is started anew."""

    def batch(df: DataFrame, number: int) -> None:
        at = f"{outcome_path}/batch={number}"
        delivery.deliver(df, registry, dead_letter, back_off=back_off, max_attempts=max_attempts).write.mode("overwrite").parquet(at)
        delivery.commit_or_raise(df.sparkSession.read.parquet(at))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def once(events: DataFrame, delay: str = "1 hour", at: str = "occurred_at") -> DataFrame:
    """The first event of each id within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(events: DataFrame, at: str, by: list[str], window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by window and columns, late rows up to the watermark included."""
    w = F.window(at, window).alias("w")
    return events.withWatermark(at, delay).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


class DriftProcessor(StatefulProcessor):
    """Keeps the type codes last seen of each table id; tells of each TABLE_MAP that differs from the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "types array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("seq")
        before = list(self.last.get()[0]) if self.last.exists() else None
        out = []
        for seq, types in zip(seen["seq"], seen["column_types"], strict=True):
            types = [int(t) for t in types]
            if before is not None and types != before:
                out.append((key[0], int(key[1]), int(seq)))
            before = types
        self.last.update((before,))
        yield pd.DataFrame(out, columns=["source", "table_id", "seq"])

    def close(self) -> None:
        pass


def drift(table_maps: DataFrame) -> DataFrame:
    """source, table_id, seq of each TABLE_MAP whose type codes differ from the last one's; needs the RocksDB state store."""
    return (
        table_maps.filter("event_type = 'TABLE_MAP'").select("source", "table_id", "seq", "column_types").groupBy("source", "table_id")
        .transformWithStateInPandas(DriftProcessor(), "source string, table_id long, seq long", "append", "none")
    )


class BinlogProcessor(StatefulProcessor):
    """Keeps of each source the log file and the last TABLE_MAP of each table id, and gives each row event what holds for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "name string")
        self.maps = handle.getMapState("maps", "table_id long", "db string, tab string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        file = self.file.get()[0] if self.file.exists() else None
        known: dict[int, tuple | None] = {}
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            if e.event_type == "ROTATE":
                file = e.rotate_file
            elif not pd.isna(e.table_id):
                ident = int(e.table_id)
                if e.event_type == "TABLE_MAP":
                    known[ident] = (e.db, e.tab)
                    self.maps.updateValue((ident,), (e.db, e.tab))
                elif e.event_type in binlog.ROWS:
                    if ident not in known:
                        known[ident] = self.maps.getValue((ident,)) if self.maps.containsKey((ident,)) else None
                    if known[ident]:
                        out.append((key[0], int(e.seq), file, *known[ident], e.raw))
        if file is not None:
            self.file.update((file,))
        yield pd.DataFrame(out, columns=["source", "seq", "file", "db", "tab", "raw"])

    def close(self) -> None:
        pass


def binlog_changes(raw: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Row changes from a stream of binlog events as JSON text, as operators.binlog.row_changes has them.  What a source's
    events need from earlier batches is kept as state; how many come at a time, and so how many a task orders, is up to the
    stream's limit by trigger.  Unreadable events are left out.  Needs the RocksDB state store."""
    e = raw.withColumn("_text", F.col("raw")).select("_text")
    e = binlog.parse(e, "_text", keep=True).filter("error is null")
    e = e.select("source", "seq", "event_type", "rotate_file", "table_id", "db", F.col("table").alias("tab"), F.col("_text").alias("raw"))
    known = e.groupBy("source").transformWithStateInPandas(BinlogProcessor(), "source string, seq long, file string, db string, tab string, raw string", "append", "none")
    told = known.select(F.col("source").alias("_s"), F.col("seq").alias("_q"), "file", F.col("db").alias("_db"), F.col("tab").alias("_tab"), "raw")
    read = binlog.parse(told, "raw", keep=True)
    read = read.select("_s", "event_type", "file", "next_position", "ts_ms", F.struct(F.col("_db").alias("db"), F.col("_tab").alias("table")).alias("map"), "rows", "_q")
    return binlog.mapped_changes(read.withColumnsRenamed({"_s": "source", "_q": "seq"}), catalog)


def outbox_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events from a folder to which unpublished outbox rows are exported as JSON lines; rows already published are left out."""
    reader = spark.readStream.schema(OUTBOX)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return outbox.events(reader.json(path).filter("published_at is null"))


class Activity(StreamingQueryListener):
    """When each query last had rows, in milliseconds; register it with spark.streams.addListener."""

    def __init__(self):
        self.last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.last[str(event.progress.id)] = int(time.time() * 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def state_of(self, query: StreamingQuery) -> dict:
        return state_of(query, int(time.time() * 1000), self.last.get(str(query.id)))


def state_of(query: StreamingQuery, now_ms: int, last_active_ms: int | None) -> dict:
    """What health() needs of a running query; ms_idle is -1 before the first batch.  Activity knows when it was active."""
    failure = query.exception()
    return {"running": query.isActive, "lifecycle_running": query.isActive, "pending": str(failure)[:200] if failure else None, "ms_idle": -1 if last_active_ms is None else now_ms - last_active_ms}
