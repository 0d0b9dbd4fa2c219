"""Delivery with bounded retry, dead letters and at-least-once progress.

deliver() is for foreachBatch: each partition publishes its events in order, retries in place, and returns outcome rows.  A
held event (no dead-letter sink, or that sink failed) makes the batch fail, so it is not committed and comes again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import backoff, positions, routing
from ..model import ENVELOPE
from .sinks import NoSinkForScheme, SinkRegistry

MAX_ATTEMPTS = 5
OUTCOME = "id string, scheme string, target string, source_checkpoint string, outcome string, attempts int, failure_type string, failure_message string, duration_ms double"
PUBLISHED, DEAD, HELD = "published", "dead_lettered", "held"


class HeldRecords(RuntimeError):
    """Some records were neither published nor dead-lettered; their batch must not be committed."""


def outcomes(attempts: DataFrame, schemes: list[str], max_attempts: int = MAX_ATTEMPTS, dead_letters: bool = True) -> DataFrame:
    """The batch form: from events with success_attempt (which attempt would succeed; null: none) the attempts made and
    what becomes of each.  An unknown scheme is permanent: one attempt, then the dead-letter sink."""
    known = F.coalesce(F.lower("scheme").isin(*[s.lower() for s in schemes]), F.lit(False))
    done = known & F.coalesce(F.col("success_attempt").between(1, max_attempts), F.lit(False))
    made = F.when(~known, 1).when(done, F.col("success_attempt")).otherwise(max_attempts)
    return attempts.withColumns(
        {"attempts": made.cast("int"), "outcome": F.when(done, PUBLISHED).otherwise(DEAD if dead_letters else HELD), "failure": F.when(~known, "NoSinkForScheme").when(~done, "exhausted"), "acked": done | F.lit(dead_letters)}
    )


def publish_partition(events: Iterator[pd.DataFrame], registry: SinkRegistry, dead_letter: Callable[[dict, Exception], None] | None, back_off: backoff.BackOff, max_attempts: int, sleep: Callable[[float], None]) -> Iterator[pd.DataFrame]:
    """Publish the events of one partition, in order, and tell what became of each."""
    for batch in events:
        rows = []
        for event in batch.to_dict("records"):
            began, failure, attempt = time.monotonic(), None, 0
            while attempt < max_attempts:
                attempt += 1
                try:
                    registry.publish(event)
                    failure = None
                    break
                except NoSinkForScheme as e:
                    failure = e
                    break
                except Exception as e:  # noqa: BLE001  a sink may raise anything
                    failure = e
                    if attempt < max_attempts:
                        sleep(back_off.delay_ms(attempt) / 1000)
            outcome = PUBLISHED if failure is None else HELD
            if failure is not None and dead_letter is not None:
                try:
                    dead_letter(event, failure)
                    outcome = DEAD
                except Exception as e:  # noqa: BLE001
                    failure.add_note(f"dead letter: {e}")
            rows.append((event["id"], event["scheme"], event["target"], event["source_checkpoint"], outcome, attempt, type(failure).__name__ if failure else None, str(failure) if failure else None, 1000 * (time.monotonic() - began)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUTCOME.split(", ")])


def deliver(events: DataFrame, registry: SinkRegistry, dead_letter: Callable[[dict, Exception], None] | None = None, *, back_off: backoff.BackOff = backoff.PUBLISH, max_attempts: int = MAX_ATTEMPTS, partitions: int | None = None, order: tuple[str, ...] = (), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Outcome rows of publishing events.  Events with one id go to one partition, in the given order, one at a time; the
    partitions run side by side.  The frame publishes each time that it is computed: write or persist it, once."""
    dealt = events.repartition(partitions, "id") if partitions else events.repartition("id")
    if order:
        dealt = dealt.sortWithinPartitions(*order)
    return dealt.mapInPandas(lambda it: publish_partition(it, registry, dead_letter, back_off, max_attempts, sleep), OUTCOME)


def commit_or_raise(outcome: DataFrame) -> None:
    """Raise if a record is held."""
    held = outcome.filter(F.col("outcome") == HELD)
    first = held.select("id", "failure_type").first()
    if first is not None:
        raise HeldRecords(f"records are held, among them {first['id']} ({first['failure_type']})")


def envelope(events: DataFrame, failure_type: Column, failure_message: Column, at: Column) -> DataFrame:
    """Dead-letter envelopes: the six fields (a position that is no LSN as 0/0, a missing message as empty text), and
    beside them what identifies the event."""
    lsn = F.when(positions.lsn_order(F.col("source_checkpoint")).isNotNull(), F.col("source_checkpoint")).otherwise(F.lit("0/0"))
    return events.select(
        routing.as_uri(F.col("scheme"), F.col("target")).alias("originalPrefix"), lsn.alias("lsn"), F.decode("payload", "UTF-8").alias("content"), failure_type.alias("failureType"),
        F.coalesce(failure_message, F.lit("")).alias("failureMessage"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("deadLetteredAt"),
        F.col("id").alias("eventId"), F.col("source_checkpoint").alias("sourceCheckpoint"), "headers", "attributes",
    )


def envelope_json(envelopes: DataFrame) -> DataFrame:
    """The six fields of each envelope as one JSON text."""
    names = [x.split()[0] for x in ENVELOPE.split(", ")]
    return envelopes.select("eventId", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("body"))


def once(events: DataFrame, order: Column) -> DataFrame:
    """The first event of each id, as consumers must see it under at-least-once delivery."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("_n = 1").drop("_n")


def dispatch(records: DataFrame) -> DataFrame:
    """The older loop's choice: messages are published, all else is discarded (and counts as done)."""
    return records.withColumn("action", F.when((F.col("kind") == "message") & F.col("error").isNull(), "publish").otherwise("discard"))


def high_water(acked: DataFrame, order: Column) -> DataFrame:
    """By checkpoint key the latest position done."""
    return acked.groupBy("key").agg(F.max_by("source_checkpoint", order).alias("source_checkpoint"))


def advanced(records: DataFrame, by: list[str], order: Column) -> DataFrame:
    """By key the position that a log may be acknowledged up to: that of the last record published or discarded before the
    first one that failed; null where the first record failed.  records: position, action, failed (of those to publish)."""
    failed = F.coalesce((F.col("action") == "publish") & F.col("failed"), F.lit(False))
    first = records.groupBy(*by).agg(F.min(F.when(failed, order)).alias("_first"))
    met = records.withColumn("_order", order).join(first, by)
    before = F.when(F.col("_first").isNull() | (F.col("_order") < F.col("_first")), F.col("_order"))
    return met.groupBy(*by).agg(F.max_by("position", before).alias("position"), F.count_if(failed).alias("failures"))


def fast_forward(slots: DataFrame, interval_ms: int = 300_000) -> DataFrame:
    """slots (acked, current, ms_idle, pending: the failure of a record that waits, or null) with advance_to: the log's current
    position where nothing came for so long and nothing waits, so that a slot without traffic doesn't hold the log back;
    else what was acknowledged."""
    idle = (F.col("ms_idle") >= interval_ms) & F.col("pending").isNull() & F.col("current").isNotNull()
    return slots.withColumn("advance_to", F.when(F.coalesce(idle, F.lit(False)), F.col("current")).otherwise(F.col("acked")))
