import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluiceway.functions.backoff import BackOff
from sluiceway.model import EVENT
from sluiceway.operators import deadletters, delivery, outbox, replay, sinks
from sluiceway.operators.sinks import CompositeSink, NoSinkForScheme, SinkRegistry

FAST = BackOff(1, 1, 1.0, 0.0)
EPOCH = datetime.datetime(1970, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(i, s, t, {"a": "r"}, bytes(b, "utf-8"), None, EPOCH, c, {"a": "h", "b": "h"}) for i, s, t, b, c in rows], EVENT)


class Sink:
    """Fails so many times for each event, then succeeds."""

    def __init__(self, failures):
        self.failures, self.tries = failures, {}

    def __call__(self, event):
        n = self.tries[event["id"]] = self.tries.get(event["id"], 0) + 1
        if n <= self.failures:
            raise TimeoutError(f"try {n}")


def publish(sink, dead=None, scheme="sns", attempts=5):
    slept, batch = [], pd.DataFrame([{"id": "1", "scheme": scheme, "target": "t", "source_checkpoint": "1"}])
    (out,) = delivery.publish_partition(iter([batch]), SinkRegistry({"SNS": sink}), dead, FAST, attempts, slept.append)
    return out.iloc[0], len(slept)


def test_retry():
    r, slept = publish(Sink(0))
    assert (r.outcome, r.attempts, slept) == ("published", 1, 0)
    r, slept = publish(Sink(2))
    assert (r.outcome, r.attempts, slept) == ("published", 3, 2)


def test_exhausted():
    letters = []
    r, slept = publish(Sink(9), lambda e, x: letters.append((e["id"], type(x).__name__)))
    assert (r.outcome, r.attempts, slept, letters) == ("dead_lettered", 5, 4, [("1", "TimeoutError")])
    r, _ = publish(Sink(9))
    assert (r.outcome, r.failure_type, r.failure_message) == ("held", "TimeoutError", "try 5")

    def broken(e, x):
        raise OSError("queue")

    assert publish(Sink(9), broken)[0].outcome == "held"


def test_unknown_scheme_is_not_tried_again():
    letters = []
    r, slept = publish(Sink(0), lambda e, x: letters.append(x), scheme="nats")
    assert (r.outcome, r.attempts, slept) == ("dead_lettered", 1, 0) and isinstance(letters[0], NoSinkForScheme) and letters[0].known == ["sns"]


def failing(event):
    if event["id"] == "bad":
        raise ValueError("no")


def test_deliver_and_commit(spark):
    e = events(spark, ("a", "sns", "t", "x", "1"), ("bad", "sns", "t", "x", "2"), ("c", "nats", "t", "x", "3"))
    out = delivery.deliver(e, SinkRegistry({"sns": failing}), back_off=FAST, max_attempts=2).persist()
    assert {r.id: (r.outcome, r.attempts) for r in out.collect()} == {"a": ("published", 1), "bad": ("held", 2), "c": ("held", 1)}
    with pytest.raises(delivery.HeldRecords):
        delivery.commit_or_raise(out)
    delivery.commit_or_raise(out.filter("outcome = 'published'"))


def test_registry_and_composite():
    got = []
    with pytest.raises(ValueError):
        SinkRegistry({" ": got.append})
    r = SinkRegistry({"SNS": got.append})
    assert r.resolve("sns") is not None and r.resolve("x") is None
    r({"scheme": "Sns"})
    with pytest.raises(NoSinkForScheme, match="sns"):
        r.publish({"scheme": "kafka"})
    assert sinks.from_config({"sns": got.append, "kafka": None}).sinks.keys() == {"sns"}

    def fail(text):
        def f(event):
            got.append(text)
            raise RuntimeError(text)

        return f

    got.clear()
    with pytest.raises(RuntimeError, match="a"):
        CompositeSink(fail("a"), fail("b"))({})
    assert got == ["a"]
    got.clear()
    with pytest.raises(RuntimeError, match="a") as e:
        CompositeSink(fail("a"), fail("b"), got.append, fail_fast=False)({"x": 1})
    assert got == ["a", "b", {"x": 1}] and "b" in e.value.__notes__[0]
    with pytest.raises(ValueError):
        CompositeSink()


def test_shapes(spark):
    e = events(spark, ("1", "sns", "ex/key/more", "é", "0/1"), ("2", "sns", "bare", "x", "0/2"))
    assert sinks.sns(e).orderBy("id").first().asDict() == {"id": "1", "topic": "ex/key/more", "body": "é", "attributes": {"a": "r", "b": "h"}}
    assert sinks.sqs(e).first().queue == "ex/key/more"
    k = sinks.kafka(e).first()
    assert bytes(k.key) == b"1" and bytes(k.value) == "é".encode() and sorted((h.key, bytes(h.value)) for h in k.headers) == [("a", b"r"), ("b", b"h")]
    assert [(r.exchange, r.routing_key, r.message_id, r.timestamp) for r in sinks.rabbitmq(e).collect()] == [("ex", "key/more", "1", EPOCH), ("", "bare", "2", EPOCH)]
    assert list(sinks.SHAPES) == ["sns", "sqs", "kafka", "amqp"]
    m = spark.createDataFrame([("t", '{"headers":{"h":"1"},"body":{"eventType":"E","domainId":"d","eventTimestamp":"2026-01-01T00:00:00","payload":{"price":1.5}}}'), ("t", "no json")], "target string, content string")
    r = sinks.legacy_sns(m).collect()
    assert (r[0].event_type, r[0].domain_id, r[0].attributes, json.loads(r[0].message)["payload"]) == ("E", "d", {"h": "1"}, {"price": 1.5})
    assert [x.body is None for x in sinks.legacy_sqs(m).collect()] == [False, True]
    assert [x.error for x in sinks.route(e, []).collect()] == ["no sink for scheme sns"] * 2


def test_outbox(spark):
    t = spark.createDataFrame([(3, "sns://c", "3", '{"k":"v"}', EPOCH, None), (1, "a", "1", None, EPOCH, EPOCH), (2, "SQS|b", "2", None, EPOCH, None)], "id long, prefix string, payload string, headers string, created_at timestamp, published_at timestamp")
    assert [r.id for r in outbox.pending(t, 1).collect()] == [2] and [r.id for r in outbox.pending(t, 5).collect()] == [2, 3]
    e = outbox.events(t, map_headers=True).filter("id = '3'").first()
    assert (e.id, e.source_checkpoint, e.scheme, e.target, e.headers, e.occurred_at) == ("3", "3", "sns", "c", {"k": "v"}, EPOCH)
    assert outbox.events(t).filter("id = '3'").first().headers == {}
    done = {r.id: r.published_at for r in outbox.mark_published(t, spark.createDataFrame([("2",), ("1",), ("x",)], "id string"), F.lit(datetime.datetime(2026, 1, 1))).collect()}
    assert done == {1: EPOCH, 2: datetime.datetime(2026, 1, 1), 3: None}
    for name in ("outbox; DROP TABLE users", "outbox events", "1outbox", "", "a\n", "outbox.events", "`x`"):
        with pytest.raises(ValueError):
            outbox.check(name, 1)
    for batch in (0, 1001):
        with pytest.raises(ValueError):
            outbox.check("t", batch)
    for name in ("outbox_events", "OutboxEvents", "_outbox", "t1", "T_42"):
        outbox.check(name, 1000)


def letter(lsn="0/16E8198", at="2026-05-15T10:00:00Z", **more):
    return json.dumps({"originalPrefix": "sns://t", "lsn": lsn, "content": '{"orderId":42}', "failureType": "TimeoutException", "failureMessage": "", "deadLetteredAt": at} | more)


def test_dead_letters(spark):
    q = spark.createDataFrame([(1, letter(more="x"), False), (2, "{torn", False), (3, letter(at="?"), True), (4, '{"lsn":"0/1"}', False)] + [(i, letter(), False) for i in range(5, 30)], "receipt long, body string, in_flight boolean").coalesce(1)
    assert [r.receipt for r in deadletters.peek(q, 3).collect()] == [1, 3]
    assert deadletters.peek(q, 0).count() == 1 and deadletters.peek(q, 99).count() == 8
    assert tuple(deadletters.stats(q).first()) == (28, 1) and tuple(deadletters.stats(q.limit(0)).first()) == (0, 0)
    now = datetime.datetime(2027, 1, 1)
    e = {r.receipt: r for r in deadletters.rebuild(deadletters.parsed(q), F.lit(now)).collect()}
    assert (e[1].id, e[1].source_checkpoint, e[1].scheme, e[1].target, bytes(e[1].payload), e[1].occurred_at) == ("0/16E8198", "0/16E8198", "sns", "t", b'{"orderId":42}', datetime.datetime(2026, 5, 15, 10))
    assert e[3].occurred_at == now and 2 not in e and 4 not in e
    to = deadletters.rebuild(deadletters.parsed(q), F.lit(now), ("kafka", "x")).first()
    assert (to.scheme, to.target) == ("kafka", "x")
    assert deadletters.override_of("kafka", " ") is None and deadletters.override_of("kafka", "x") == ("kafka", "x")
    assert deadletters.abandon(q, spark.createDataFrame([(2,)], "receipt long")).count() == 28


def test_envelope_round_trip_keeps_identity(spark):
    e = events(spark, ("order:1", "sns", "t", "body", "mysql-bin.000001:7"), ("x", "sns", "t", "b", "0/AB"))
    env = delivery.envelope(e, F.lit("TimeoutException"), F.lit(None).cast("string"), F.lit(EPOCH))
    assert [(r.lsn, r.failureMessage, r.deadLetteredAt, r.originalPrefix) for r in env.collect()] == [("0/0", "", "1970-01-01T00:00:00Z", "sns://t"), ("0/AB", "", "1970-01-01T00:00:00Z", "sns://t")]
    q = env.select(F.monotonically_increasing_id().alias("receipt"), F.to_json(F.struct("*")).alias("body"), F.lit(False).alias("in_flight"))
    back = deadletters.rebuild(deadletters.parsed(q), F.current_timestamp())
    assert sorted((r.id, r.source_checkpoint, r.headers["b"], r.attributes["a"]) for r in back.collect()) == [("order:1", "mysql-bin.000001:7", "h", "r"), ("x", "0/AB", "h", "r")]


def rows_of(spark, n):
    d = spark.range(n).select(F.lit("mysql-bin.000001").alias("file"), F.col("id").alias("pos"), F.lit(0).alias("seq"), (F.col("id") % 2 == 0).alias("kept"), F.lit(False).alias("failed"), F.lit("sns").alias("scheme"), F.lit("t").alias("target"))
    return lambda a, b: replay.window(d, a, b)


A, B = "mysql-bin.000001:0", "mysql-bin.000001:6"


def test_replay_window(spark):
    d = spark.createDataFrame([("b.2", 5), ("b.2", 9), ("b.3", 1), ("b.1", 99), ("b.4", 1)], "file string, pos long")
    assert sorted(map(tuple, replay.window(d, "b.2:5", "b.3:2").collect())) == [("b.2", 9), ("b.3", 1)]
    assert replay.window(d, "b.2:5", "b.2:9").count() == 0
    for bad in ("x", "", None, "f:y"):
        with pytest.raises(replay.UnsupportedReplay):
            replay.position(bad)


def test_replay_jobs(spark):
    s = replay.ReplayService({"binlog": rows_of(spark, 10), "pg-wal": replay.postgres_source}, most=4)
    j = s.start("binlog", A, B)
    assert (j.status, j.cap_reached, j.counts) == ("SUCCEEDED", True, {"read": 4, "published": 2, "filtered": 2, "failed": 0, "would_publish": 0}) and s.status(j.id) is j
    j = s.start("binlog", A, "mysql-bin.000001:3", dry_run=True)
    assert j.counts["would_publish"] == 1 and j.counts["published"] == 0 and not j.cap_reached
    j = s.start("pg-wal", "a", "b")
    assert j.status == "FAILED" and "UnsupportedReplay" in j.error
    with pytest.raises(replay.UnsupportedReplay):
        s.start("nothing", A, B)
    t = replay.ReplayService({"binlog": rows_of(spark, 10)}, publish=lambda d: d.withColumn("failed", F.col("pos") == 2))
    assert t.start("binlog", A, B).counts == {"read": 5, "published": 1, "filtered": 3, "failed": 1, "would_publish": 0}
    t._active.acquire()
    with pytest.raises(RuntimeError):
        t.start("binlog", A, B)
