import json
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sluiceway.config import Config, build_source
from sluiceway.functions.backoff import BackOff
from sluiceway.operators import binlog, mapping
from sluiceway.operators.sinks import SinkRegistry
from sluiceway.sources.logdir import LogFolder
from sluiceway.streaming import pipelines

FAST = BackOff(1, 1, 1.0, 0.0)


def record(i, table="orders"):
    return json.dumps({"xid": i, "action": "I", "lsn": f"0/{i + 16:X}", "schema": "public", "table": table, "columns": [{"name": "id", "type": "int", "value": i}]})


CONFIG = {"source": "postgres_rows", "mappings": [{"table": "public.orders", "key": {"columns": ["id"]}, "routing": {"sink": "sns://t"}}]}


class FileSink:
    """Appends the ids of events to a file; fails for some while a marker is there."""

    def __init__(self, path, marker, bad):
        self.path, self.marker, self.bad = path, marker, bad

    def __call__(self, event):
        if event["id"] == self.bad and os.path.exists(self.marker):
            raise TimeoutError(event["id"])
        with open(self.path, "a") as f:
            f.write(event["id"] + "\n")


def test_a_held_record_stops_the_batch_and_it_comes_again(spark, tmp_path):
    raw, sink, marker = tmp_path / "raw", tmp_path / "sent", tmp_path / "down"
    raw.mkdir()
    (raw / "1.json").write_text("\n".join(record(i) for i in range(5)) + "\n" + record(9, "other") + "\n{torn\n")
    marker.write_text("")
    registry = SinkRegistry({"sns": FileSink(str(sink), str(marker), "3")})
    e = build_source(spark, Config.from_dict(CONFIG | {"path": str(raw)}))
    run = lambda: pipelines.start_delivery(e, registry, str(tmp_path / "cp"), str(tmp_path / "out"), back_off=FAST, max_attempts=2)
    with pytest.raises(StreamingQueryException):
        run().awaitTermination()
    marker.unlink()
    run().awaitTermination()
    assert set(sink.read_text().split()) == {"0", "1", "2", "3", "4"}
    n = len(sink.read_text().split())
    run().awaitTermination()  # nothing new
    assert len(sink.read_text().split()) == n
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.id, r.outcome) for r in out.collect()} == {(str(i), "published") for i in range(5)}


def test_stream_and_batch_give_the_same_events(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for k in range(3):
        (raw / f"{k}.json").write_text("\n".join(record(10 * k + i) for i in range(4)))
    rules = Config.from_dict(CONFIG).mappings
    s = pipelines.row_events(pipelines.raw_records(spark, str(raw), 1), rules)
    q = s.select("id", "source_checkpoint", F.decode("payload", "UTF-8").alias("p")).writeStream.format("memory").queryName("same").trigger(availableNow=True).start()
    q.awaitTermination()
    b = pipelines.row_events(spark.read.text(str(raw)).select(F.col("value").alias("raw")), rules).select("id", "source_checkpoint", F.decode("payload", "UTF-8"))
    assert sorted(map(tuple, spark.table("same").collect())) == sorted(map(tuple, b.collect())) and len(q.recentProgress) >= 3
    assert pipelines.state_of(q, 5, None) == {"running": False, "lifecycle_running": False, "pending": None, "ms_idle": -1}


def test_dedup_within_watermark(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    m = json.dumps({"xid": 1, "action": "M", "prefix": "sns://t", "content": "x", "lsn": "0/5"})
    (raw / "1").write_text(f"{m}\n{m}")
    e = pipelines.once(pipelines.message_events(pipelines.raw_records(spark, str(raw))))
    q = e.select("id").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.table("once").collect()] == ["0/5"]
    counts = pipelines.windowed_counts(pipelines.message_events(pipelines.raw_records(spark, str(raw))), "occurred_at", ["scheme"])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("counts").collect()] == [2]


def test_stateful_drift_agrees_with_the_batch_form(spark, tmp_path):
    types = [[3, 15], [3, 15], [8, 15], [8], [8], [3, 15]]
    rows = [{"source": "s", "seq": i, "event_type": "TABLE_MAP", "table_id": i % 2, "db": "d", "table": "t", "column_types": t} for i, t in enumerate(types + types)]
    schema = "source string, seq long, event_type string, table_id long, db string, `table` string, column_types array<int>"
    d = tmp_path / "maps"
    d.mkdir()
    for k in range(3):
        (d / f"{k}.json").write_text("\n".join(map(json.dumps, rows[4 * k : 4 * k + 4])))
        os.utime(d / f"{k}.json", (1000 + k, 1000 + k))
    s = pipelines.drift(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d)))
    q = s.writeStream.format("memory").queryName("drift").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = binlog.table_maps(spark.read.schema(schema).json(str(d))).filter("drift").select("source", "table_id", "seq")
    assert sorted(map(tuple, spark.table("drift").collect())) == sorted(map(tuple, batch.collect())) != []


def sizes(q):
    return [p.numInputRows for p in q.recentProgress if p.numInputRows]


def test_log_folder_source(spark, tmp_path):
    """No batch has more segments than allowed: on the first start with a backlog, later, and after a restart."""
    spark.dataSource.register(LogFolder)
    d = tmp_path / "log"
    d.mkdir()
    for k in range(5):
        (d / f"{k}.log").write_text(f"a{k}\nb{k}\n")
    assert spark.read.format("logfolder").load(str(d)).count() == 10
    s = spark.readStream.format("logfolder").option("maxSegmentsPerTrigger", 2).load(str(d))
    out = str(tmp_path / "out")
    run = lambda: s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
    q = run()
    q.processAllAvailable()
    assert sizes(q) == [4, 4, 2]
    (d / "5.log").write_text("a5\n")
    q.processAllAvailable()
    q.stop()
    assert sizes(q) == [4, 4, 2, 1] and (d / "acked").exists()
    for k in range(6, 11):
        (d / f"{k}.log").write_text(f"a{k}\n")
    q = run()
    q.processAllAvailable()
    q.stop()
    assert sum(sizes(q)) == 5 and max(sizes(q)) <= 2
    want = [f"{x}{k}" for k in range(5) for x in "ab"] + [f"a{k}" for k in range(5, 11)]
    assert sorted(r.raw for r in spark.read.parquet(out).collect()) == sorted(want)


def test_a_new_query_begins_at_the_first_segment(tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.log").write_text("x\n")
    (tmp_path / "acked").write_text("3")
    fresh = LogFolder({"path": str(tmp_path), "maxSegmentsPerTrigger": "1"}).streamReader(None)
    assert fresh.initialOffset() == {"next": 0} and [fresh.latestOffset()["next"] for _ in range(6)] == [1, 2, 3, 4, 4, 4]
    again = LogFolder({"path": str(tmp_path), "maxSegmentsPerTrigger": "1"}).streamReader(None)
    assert again.latestOffset() == {"next": 4}


def binlog_lines():
    base = {"next_position": 100, "ts_ms": 1700000000000}
    out, seq = [], {"s": 0, "t": 0}
    for i in range(12):
        source = "st"[i % 2]
        events = [{"event_type": "QUERY"}, {"event_type": "WRITE_ROWS", "table_id": 1 + i % 3, "rows": [{"before": None, "after": [i, "x"]}, {"before": None, "after": [i + 100, None]}]}]
        if i in (1, 2, 9):
            events.insert(0, {"event_type": "ROTATE", "rotate_file": f"log.{i}"})
        if i in (0, 1, 4, 5, 8):
            events.insert(1, {"event_type": "TABLE_MAP", "table_id": 1 + i % 3, "db": "shop", "table": f"t{i}", "column_types": [3, 15]})
        if i == 7:
            events.append({"event_type": "DELETE_ROWS", "table_id": 1 + i % 3, "rows": [{"before": [i, "gone"], "after": None}]})
        for e in events:
            out.append(json.dumps(base | {"source": source, "seq": seq[source]} | e))
            seq[source] += 1
    return out + ["{torn"]


def test_binlog_stream_gives_the_changes_of_the_batch_form(spark, tmp_path):
    d, lines = tmp_path / "binlog", binlog_lines()
    d.mkdir()
    for k in range(0, len(lines), 7):  # an event and its map are often in different batches
        (d / f"{k:03}.json").write_text("\n".join(lines[k : k + 7]))
        os.utime(d / f"{k:03}.json", (1000 + k, 1000 + k))
    names = spark.createDataFrame([("shop", "t4", "id", 1), ("shop", "t4", "name", 2)], "table_schema string, table_name string, column_name string, ordinal_position int")
    told = lambda c: c.select("op", "table", "source_checkpoint", "seq", "occurred_at", F.to_json("before").alias("b"), F.to_json("after").alias("a"), "source", "log_seq")
    q = told(pipelines.binlog_changes(pipelines.raw_records(spark, str(d), 1), names)).writeStream.format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = told(binlog.row_changes(binlog.parse(spark.createDataFrame([(x,) for x in lines], "raw string")).filter("error is null").drop("error"), names))
    got = sorted(map(repr, spark.table("changes").collect()))
    assert got == sorted(map(repr, batch.collect())) and len(got) > 10
    config = {"source": "binlog", "path": str(d), "files_per_trigger": 2, "mappings": [{"table": "shop.t4", "key": {"columns": ["id"]}, "routing": {"sink": "sns://t"}}]}
    rules = Config.from_dict(config).mappings
    keys = mapping.apply(binlog.row_changes(binlog.parse(spark.createDataFrame([(x,) for x in lines], "raw string")).filter("error is null").drop("error"), names), rules)
    q = build_source(spark, Config.from_dict(config), names).select("id").writeStream.format("memory").queryName("keys").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("keys").collect()) == sorted(r.id for r in keys.collect()) != []


def test_outbox_stream(spark, tmp_path):
    d = tmp_path / "outbox"
    d.mkdir()
    (d / "1.json").write_text("\n".join(json.dumps({"id": i, "prefix": "sns://t", "payload": "{}", "created_at": "2024-01-01T00:00:00Z"} | ({"published_at": "2024-01-02T00:00:00Z"} if i == 2 else {})) for i in range(4)))
    q = build_source(spark, Config.from_dict({"source": "outbox", "path": str(d)})).select("id", "scheme").writeStream.format("memory").queryName("outbox").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("outbox").collect())) == [("0", "sns"), ("1", "sns"), ("3", "sns")]


def test_activity_knows_when_rows_came(spark, tmp_path):
    activity = pipelines.Activity()
    spark.streams.addListener(activity)
    try:
        (tmp_path / "raw").mkdir()
        (tmp_path / "raw/1").write_text("x")
        q = pipelines.raw_records(spark, str(tmp_path / "raw")).writeStream.format("memory").queryName("activity").start()
        q.processAllAvailable()
        for _ in range(50):
            if activity.last:
                break
            time.sleep(0.1)
        state = activity.state_of(q)
        assert state["running"] and 0 <= state["ms_idle"] < 60_000
        q.stop()
    finally:
        spark.streams.removeListener(activity)
