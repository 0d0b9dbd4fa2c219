"""Queries of sinks, delivery, the outbox, dead letters and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import backoff, positions
from ..functions.workers import importable
from ..operators import deadletters, delivery, outbox, replay, sinks, wal2json
from .catalogue import query
from .changes import D_BINLOG, D_CHANGES, D_OUTBOX, D_SHAPES, ORDERS, _events, raw_v2
from .fixtures import BINLOG_EVENTS, CHANGES, OUTBOX, in_spark

SCHEMES = ["sns", "SQS", "kafka"]


def outbox_rows(spark, sf_dir) -> DataFrame:
    return in_spark(spark, sf_dir, OUTBOX).select(F.col("id"), "prefix", "payload", F.lit(None).cast("string").alias("headers"), F.col("created_at").cast("timestamp").alias("created_at"), F.col("published_at").cast("timestamp").alias("published_at"), "success_attempt")


def outbox_events(spark, sf_dir) -> DataFrame:
    rows = outbox_rows(spark, sf_dir)
    return outbox.events(rows).join(rows.select(F.col("id").cast("string").alias("id"), "success_attempt"), "id")


@query(f"select id, prefix, payload, created_at from ({D_OUTBOX}) where published_at is null order by id limit 1000")
def s06_outbox_pending(spark, sf_dir):
    """The first unpublished rows (S6; the limit is the feature)."""
    return outbox.pending(outbox_rows(spark, sf_dir), 1000).select("id", "prefix", "payload", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"select n, n in ('outbox_events', 'OutboxEvents', '_outbox', 't1', 'T_42') as ok, count(*) as k from (select unnest(['outbox; DROP TABLE users', 'outbox events', '1outbox', '', 'outbox-events', 'outbox.events', 'outbox_events', 'OutboxEvents', '_outbox', 't1', 'T_42', '`x`']) as n, id from ({D_OUTBOX})) group by all")
def s07_table_names(spark, sf_dir):
    """Which names are plain identifiers."""
    names = ["outbox; DROP TABLE users", "outbox events", "1outbox", "", "outbox-events", "outbox.events", "outbox_events", "OutboxEvents", "_outbox", "t1", "T_42", "`x`"]
    d = in_spark(spark, sf_dir, OUTBOX).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("n"))
    return d.groupBy("n", outbox.name_ok(F.col("n")).alias("ok")).agg(F.count(F.lit(1)).alias("k"))


_ROUTED = f"""
select cast(id as varchar) as id, case id % 4 when 0 then 'kafka' when 1 then 'sqs' when 2 then 'sns' else 'nats' end as scheme,
       case id % 4 when 0 then substring(prefix, instr(prefix, '://') + 3) when 1 then substring(prefix, instr(prefix, '|') + 1) when 2 then prefix else substring(prefix, instr(prefix, '://') + 3) end as target, payload, created_at, success_attempt, id as n
from ({D_OUTBOX})"""


@query(f"select id, scheme, target, payload, id as source_checkpoint, created_at as occurred_at from ({_ROUTED})")
def m17_outbox_events(spark, sf_dir):
    """Events of outbox rows."""
    e = outbox.events(outbox_rows(spark, sf_dir))
    return e.select("id", "scheme", "target", F.decode("payload", "UTF-8").alias("payload"), "source_checkpoint", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


@query(f"select id, prefix, created_at, case when published_at is null and id % 2 = 0 then timestamp '2024-06-01 00:00:00' else published_at end as published_at from ({D_OUTBOX})")
def d11_marked_published(spark, sf_dir):
    """Delivered ids marked in a new version of the table."""
    rows = outbox_rows(spark, sf_dir)
    done = outbox.mark_published(rows, outbox.events(rows).filter("cast(source_checkpoint as bigint) % 2 = 0"), F.to_timestamp(F.lit("2024-06-01 00:00:00")))
    return done.select("id", "prefix", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "published_at")])


@query(f"select id, scheme, case when scheme = 'nats' then null else scheme end as sink, case when scheme = 'nats' then 'no sink for scheme nats' end as error from ({_ROUTED})")
def k03_routed(spark, sf_dir):
    """Sinks by scheme in any case; unknown schemes apart (K2, K3, K9)."""
    return sinks.route(outbox.events(outbox_rows(spark, sf_dir)), SCHEMES).select("id", "scheme", "sink", "error")


_SHAPED = "select k, concat('order:', k) as id, 'orders' as target, status, case op when 'INSERT' then 'orders.created' else 'orders.updated' end as kind, cast(json_object('id', k, 'status', status, 'totalCents', cents) as varchar) as body from ({}) where op <> 'DELETE'"


def _shaped(spark, sf_dir):
    e = _events(spark, sf_dir, ORDERS)
    return e.withColumn("headers", sinks.snapshots.merged(F.col("headers"), F.create_map(F.lit("state"), F.lit("from headers"), F.lit("h"), F.lit("1"))))



@query(f"select target as topic, body, 4 as n, kind as event_type, status as state, 'db' as source, '1' as h from ({_SHAPED.format(D_CHANGES)})")
def k04_sns_rows(spark, sf_dir):
    """Topic, text body, headers under routing attributes (K4, K5)."""
    a = F.col("attributes")
    return sinks.sns(_shaped(spark, sf_dir)).select("topic", "body", F.size(a).alias("n"), a["eventType"].alias("event_type"), a["state"].alias("state"), a["source"].alias("source"), a["h"].alias("h"))


@query(f"select target as queue, body, status as state from ({_SHAPED.format(D_CHANGES)})")
def k05_sqs_rows(spark, sf_dir):
    return sinks.sqs(_shaped(spark, sf_dir)).select("queue", "body", F.col("attributes.state").alias("state"))


@query(f"select target as topic, id as key, body as value, concat('eventType=', kind, ',h=1,source=db,state=', status) as headers from ({_SHAPED.format(D_CHANGES)})")
def k06_kafka_rows(spark, sf_dir):
    """Topic, key, value, headers, as the Kafka writer takes them (K6)."""
    text = F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), F.decode(h["value"], "UTF-8")))), ",")
    return sinks.kafka(_shaped(spark, sf_dir)).select("topic", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), text.alias("headers"))


@query(f"select case when n % 2 = 0 then 'ex' else '' end as exchange, case when n % 2 = 0 then concat('a/', n) else cast(n as varchar) end as routing_key, id as message_id, created_at as timestamp from ({_ROUTED})")
def k07_rabbitmq_rows(spark, sf_dir):
    """Exchange and routing key at the first slash (K7)."""
    n = F.col("source_checkpoint")
    e = outbox.events(outbox_rows(spark, sf_dir)).withColumn("target", F.when(n.cast("long") % 2 == 0, F.concat(F.lit("ex/a/"), n)).otherwise(n))
    return sinks.rabbitmq(e).select("exchange", "routing_key", "message_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query(f"""
select n as event, case when n % 5 = 0 then 2 else 3 end as tried_fast, n % 5 <> 0 and n % 7 <> 0 as ok, case when n % 5 = 0 then 'b' when n % 7 = 0 then 'c' end as first_failure, (n % 5 = 0)::int + (n % 7 = 0)::int as failures from ({_ROUTED})""")
def k08_fan_out(spark, sf_dir):
    """Delegates in order; stopping at the first failure or trying all (K8)."""
    d = in_spark(spark, sf_dir, OUTBOX).select(F.col("id").alias("event"), F.posexplode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("place", "delegate"))
    d = d.withColumn("ok", ~(((F.col("delegate") == "b") & (F.col("event") % 5 == 0)) | ((F.col("delegate") == "c") & (F.col("event") % 7 == 0))))
    fast = sinks.fan_out(d).select("event", F.col("tried").cast("int").alias("tried_fast"), "ok", "first_failure")
    return fast.join(sinks.fan_out(d, False).select("event", F.col("failures").cast("int").alias("failures")), "event")


@query(f"""
select id, case when scheme = 'nats' then 1 when success_attempt between 1 and 5 then success_attempt else 5 end::int as attempts,
       case when scheme <> 'nats' and success_attempt between 1 and 5 then 'published' else 'dead_lettered' end as outcome, case when scheme = 'nats' then 'NoSinkForScheme' when success_attempt not between 1 and 5 then 'exhausted' end as failure, true as acked
from ({_ROUTED})""")
def d02_outcomes(spark, sf_dir):
    """Attempts and outcomes with a dead-letter sink."""
    return delivery.outcomes(outbox_events(spark, sf_dir), SCHEMES).select("id", "attempts", "outcome", "failure", "acked")


@query(f"select outcome, acked, count(*) as n, sum(attempts)::bigint as attempts from (select case when scheme <> 'nats' and success_attempt between 1 and 3 then 'published' else 'held' end as outcome, scheme <> 'nats' and success_attempt between 1 and 3 as acked, case when scheme = 'nats' then 1 when success_attempt between 1 and 3 then success_attempt else 3 end as attempts from ({_ROUTED})) group by all")
def d05_held(spark, sf_dir):
    """Without a dead-letter sink what is exhausted is held."""
    o = delivery.outcomes(outbox_events(spark, sf_dir), SCHEMES, max_attempts=3, dead_letters=False)
    return o.groupBy("outcome", "acked").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


@query(f"select n, least(100.0 * power(2.0, greatest(n, 1) - 1), 5000.0) as delay_ms from (select n % 40 - 2 as n from ({_ROUTED})) group by n")
def d07_back_off(spark, sf_dir):
    """Delays by attempt, without jitter."""
    d = in_spark(spark, sf_dir, OUTBOX).select((F.col("id") % 40 - 2).alias("n")).distinct()
    return d.select("n", backoff.PUBLISH.column(F.col("n")).alias("delay_ms"))


def dead(spark, sf_dir) -> DataFrame:
    """Envelopes of what d02_outcomes dead-letters."""
    o = delivery.outcomes(outbox_events(spark, sf_dir), SCHEMES).filter("outcome = 'dead_lettered'")
    message = F.when(F.col("failure") == "exhausted", None).otherwise("unknown")
    return delivery.envelope(o, F.col("failure"), message, F.col("occurred_at"))


_DEAD = f"""
select n, id, concat(scheme, '://', target) as prefix, payload, case when scheme = 'nats' then 'NoSinkForScheme' else 'exhausted' end as failure, case when scheme = 'nats' then 'unknown' else '' end as message, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as dead_at, created_at
from ({_ROUTED}) where scheme = 'nats' or success_attempt not between 1 and 5"""


@query(f"""select id as "eventId", cast(json_object('originalPrefix', prefix, 'lsn', '0/0', 'content', payload, 'failureType', failure, 'failureMessage', message, 'deadLetteredAt', dead_at) as varchar) as body from ({_DEAD})""")
def d09_envelopes(spark, sf_dir):
    """Dead-letter envelopes: six fields."""
    return delivery.envelope_json(dead(spark, sf_dir))


@query(f"select action, count(*) as n from (select case when shape = 'message' then 'publish' else 'discard' end as action from ({D_SHAPES})) group by action")
def d16_dispatch(spark, sf_dir):
    """The older loop publishes messages and discards the rest."""
    return delivery.dispatch(wal2json.decode_v2(raw_v2(spark, sf_dir))).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"select cast(n % 100 as varchar) as id, min(n) as n from ({_ROUTED}) group by 1")
def d20_once(spark, sf_dir):
    """The first delivery of each id."""
    e = outbox.events(outbox_rows(spark, sf_dir)).withColumn("n", F.col("source_checkpoint").cast("long")).withColumn("id", (F.col("n") % 100).cast("string"))
    return delivery.once(e, F.col("n")).select("id", "n")


@query(f"""select concat('binlog:', source) as key, max_by(concat('mysql-bin.000001:', next_position), seq) as source_checkpoint, concat('binlog_', source) as file from ({D_BINLOG}) group by source""")
def c07_high_water(spark, sf_dir):
    """The latest position by source, its key and file name."""
    d = in_spark(spark, sf_dir, BINLOG_EVENTS).select(positions.checkpoint_key(F.lit("binlog"), F.col("source")).alias("key"), F.concat(F.lit("mysql-bin.000001:"), F.col("next_position").cast("string")).alias("source_checkpoint"), "seq")
    return delivery.high_water(d, F.col("seq")).withColumn("file", positions.checkpoint_file_name(F.col("key")))


def _log(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    file = F.concat(F.lit("mysql-bin."), F.lpad((k / 1000).cast("int").cast("string"), 6, "0"))
    return in_spark(spark, sf_dir, BINLOG_EVENTS).filter("event_type like '%ROWS'").select(file.alias("file"), (k % 1000 * 16).cast("long").alias("pos"), F.lit(0).alias("seq"), k.alias("k"))


_REPLAY = f"""
select k, concat('mysql-bin.', lpad(cast(cast(floor(k / 1000) as bigint) as varchar), 6, '0')) as file, k % 1000 * 16 as pos from ({D_BINLOG}) where event_type like '%ROWS'"""
_WINDOW = f"select * from ({_REPLAY}) where file = 'mysql-bin.000000' and pos > 320 and pos < 9600"


@query(f"select k, file, pos from ({_WINDOW})")
def p02_window(spark, sf_dir):
    """Rows between two positions, without the end."""
    return replay.window(_log(spark, sf_dir), "mysql-bin.000000:320", "mysql-bin.000000:9600").select("k", "file", "pos")


def _replayed(spark, sf_dir):
    w = replay.window(_log(spark, sf_dir), "mysql-bin.000000:320", "mysql-bin.000000:9600")
    return w.withColumns({"kept": F.col("k") % 4 != 0, "failed": F.col("k") % 9 == 1, "scheme": F.lit("sns"), "target": F.lit("t")})


@query(f"select k, case when k % 4 = 0 then 'filtered' when k % 9 = 1 then 'failed' else 'published' end as outcome, 'kafka' as scheme, 'topic-x' as target from ({_WINDOW})")
def p08_outcomes(spark, sf_dir):
    """What becomes of each row, with another address."""
    return replay.outcomes(_replayed(spark, sf_dir), to=("kafka", "topic-x")).select("k", "outcome", "scheme", "target")


@query(f"""
select count(*) as read, count(*) filter (k % 4 <> 0 and k % 9 <> 1) as published, count(*) filter (k % 4 = 0) as filtered, count(*) filter (k % 4 <> 0 and k % 9 = 1) as failed, 0::bigint as would_publish, count(*) >= 100 as cap_reached, 'SUCCEEDED' as status
from (select * from ({_WINDOW}) order by file, pos limit 100)""")
def p09_job(spark, sf_dir):
    """One row for a capped job."""
    w = replay.capped(_replayed(spark, sf_dir), [F.col("file"), F.col("pos")], 100)
    return replay.job_summary(replay.outcomes(w), 100)


@query(f"select count(*) as read, 0::bigint as published, count(*) filter (k % 4 = 0) as filtered, 0::bigint as failed, count(*) filter (k % 4 <> 0) as would_publish, false as cap_reached, 'SUCCEEDED' as status from ({_WINDOW})")
def p08_dry_run(spark, sf_dir):
    return replay.job_summary(replay.outcomes(_replayed(spark, sf_dir), dry_run=True))


def queue(spark, sf_dir) -> DataFrame:
    """Dead letters as a queue: receipt, body, in_flight; every seventh body is torn."""
    names = ["originalPrefix", "lsn", "content", "failureType", "failureMessage", "deadLetteredAt", "eventId", "sourceCheckpoint"]
    n = F.col("eventId").cast("long")
    late = F.when(n % 11 == 0, F.lit("some day")).otherwise(F.col("deadLetteredAt"))
    plain = F.to_json(F.struct(*[late.alias(c) if c == "deadLetteredAt" else F.col(c) for c in names[:6]]))
    full = F.to_json(F.struct(*[late.alias(c) if c == "deadLetteredAt" else F.col(c) for c in names], F.lit(1).alias("unknown")))
    body = F.when(n % 7 == 3, F.lit('{"lsn":"0/1"')).when(n % 2 == 0, plain).otherwise(full)
    return dead(spark, sf_dir).select(n.alias("receipt"), body.alias("body"), (n % 5 == 0).alias("in_flight"))


@query(f"select n as receipt, prefix from (select * from ({_DEAD}) order by n limit 10) where n % 7 <> 3")
def q02_peek(spark, sf_dir):
    """The first ten messages, torn ones left out after the limit (Q2; the limit is the feature)."""
    return deadletters.peek(queue(spark, sf_dir), 50).select("receipt", F.col("envelope.originalPrefix").alias("prefix"))


@query(f"select count(*) filter (n % 5 <> 0) as visible, count(*) filter (n % 5 = 0) as in_flight from ({_DEAD})")
def q03_stats(spark, sf_dir):
    return deadletters.stats(queue(spark, sf_dir))


@query(f"""
select n as receipt, case when n % 2 = 0 then '0/0' else id end as id, case when n % 2 = 0 then '0/0' else id end as source_checkpoint, split_part(prefix, '://', 1) as scheme, substring(prefix, instr(prefix, '://') + 3) as target, payload,
       case when n % 11 = 0 then timestamp '2030-01-01 00:00:00' else date_trunc('second', created_at) end as occurred_at
from ({_DEAD}) where n % 7 <> 3""")
def q07_rebuilt(spark, sf_dir):
    """Events from dead letters; own identity where the envelope has it."""
    now = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    e = deadletters.rebuild(deadletters.parsed(queue(spark, sf_dir)), now)
    return e.select("receipt", "id", "source_checkpoint", "scheme", "target", F.decode("payload", "UTF-8").alias("payload"), F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


@query(f"""
select count(*) as total, count(*) filter (n % 3 <> 0 and n % 13 <> 0) as success, count(*) filter (n % 3 <> 0 and n % 13 = 0) as success_delete_failed, count(*) filter (n % 3 = 0) as publish_failed, 0::bigint as dry_run from ({_DEAD}) where n % 7 <> 3""")
def q05_bulk(spark, sf_dir):
    """Outcomes of a bulk replay (Q4, Q5)."""
    e = deadletters.rebuild(deadletters.parsed(queue(spark, sf_dir)), F.current_timestamp())
    n = F.col("receipt")
    return deadletters.summary(e.select(deadletters.replay_outcome(n % 3 != 0, n % 13 != 0).alias("outcome")))


def _down_for_some(event: dict) -> None:
    """A sink that is down for payloads of certain lengths."""
    if len(event["payload"].decode()) % 3 == 0:
        raise TimeoutError("down")


@query(f"""
select n as receipt, 'kafka' as scheme, case when length(payload) % 3 = 0 then 'publish_failed' when n % 13 = 0 then 'success_delete_failed' else 'success' end as outcome,
       case when length(payload) % 3 = 0 then 'TimeoutError' end as failure_type, case when length(payload) % 3 = 0 then 'down' end as failure_message
from ({_DEAD}) where n % 7 <> 3""")
def q04_replayed(spark, sf_dir):
    """Letters published one by one, then deleted but for some: the three outcomes (Q4, Q5)."""
    letters = deadletters.parsed(queue(importable(spark), sf_dir)).filter("valid")
    sent = deadletters.publish(deadletters.rebuild(letters, F.current_timestamp(), ("kafka", "again")), sinks.SinkRegistry({"kafka": _down_for_some}))
    return deadletters.replayed(sent, letters.filter("receipt % 13 <> 0").select("receipt"))


@query(f"select n as receipt from ({_DEAD}) where n % 6 <> 0")
def q06_abandoned(spark, sf_dir):
    q = queue(spark, sf_dir)
    return deadletters.abandon(q, q.filter("receipt % 6 = 0")).select("receipt")


@query(f"select n as receipt, 'kafka' as scheme, 'dead' as target from ({_DEAD}) where n % 7 <> 3")
def q08_override(spark, sf_dir):
    e = deadletters.rebuild(deadletters.parsed(queue(spark, sf_dir)), F.current_timestamp(), deadletters.override_of("kafka", "dead"))
    return e.select("receipt", "scheme", "target")


@query(f"""
with r as (select cust, k, lsn, case when k % 97 = 5 then 'discard' else 'publish' end as action, k % 41 = 3 as failed from ({D_CHANGES})),
f as (select cust, min(k) filter (action = 'publish' and failed) as first, count(*) filter (action = 'publish' and failed) as failures from r group by cust)
select r.cust as slot, arg_max(lsn, k) filter (first is null or k < first) as position, any_value(failures) as failures from r join f on r.cust = f.cust group by r.cust""")
def d19_advanced(spark, sf_dir):
    """Positions up to the first failure: published and discarded records advance, failed ones never."""
    c = in_spark(spark, sf_dir, CHANGES)
    records = c.select(F.col("cust").alias("slot"), "k", F.col("lsn").alias("position"), F.when(F.col("k") % 97 == 5, "discard").otherwise("publish").alias("action"), (F.col("k") % 41 == 3).alias("failed"))
    return delivery.advanced(records, ["slot"], F.col("k"))


@query(f"select k, case when k % 600 >= 300 and k % 7 <> 2 then concat('0/', upper(to_hex(k * 128))) else lsn end as advance_to from ({D_CHANGES})")
def d18_fast_forward(spark, sf_dir):
    """Idle slots go on to the current position unless a record waits."""
    c = in_spark(spark, sf_dir, CHANGES)
    slots = c.select("k", F.col("lsn").alias("acked"), F.concat(F.lit("0/"), F.hex(F.col("k") * 128)).alias("current"), (F.col("k") % 600 * 1000).alias("ms_idle"), F.when(F.col("k") % 7 == 2, "timeout").alias("pending"))
    return delivery.fast_forward(slots).select("k", "advance_to")


@query(f"select n as id, 'sns' as scheme, cast(n as varchar) as target, concat('{{\"a\":', n, '}}') as body from ({_ROUTED})")
def k12_legacy_bodies(spark, sf_dir):
    """Content parsed and written again."""
    d = in_spark(spark, sf_dir, OUTBOX).select("id", F.col("id").cast("string").alias("target"), F.concat(F.lit('{ "a" : '), F.col("id").cast("string"), F.lit(" }")).alias("content"))
    return d.select("id").join(sinks.legacy_sqs(d).select(F.col("queue").cast("long").alias("id"), "body"), "id").select("id", F.lit("sns").alias("scheme"), F.col("id").cast("string").alias("target"), "body")
