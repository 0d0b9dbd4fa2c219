"""Dead letters: looking at them, rebuilding events, replaying and abandoning.

A queue has receipt, body and in_flight.  A replay publishes first and deletes then: a letter whose publishing fails stays,
and one that can't be deleted may be published again, as delivery is at least once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing
from ..functions.parse import with_parsed
from ..model import ENVELOPE, ENVELOPE_MORE
from ..ports import LetterQueue
from .sinks import SinkRegistry

PEEK = (1, 10)


def parsed(queue: DataFrame) -> DataFrame:
    """queue with the envelope of each body (extra fields are allowed) and valid: whether it is one."""
    q = with_parsed(queue, "body", f"{ENVELOPE}, {ENVELOPE_MORE}, _bad string", "_e")
    e = F.col("_e")
    names = [x.split()[0] for x in ENVELOPE.split(", ")]
    ok = e["_bad"].isNull()
    for n in names:
        ok = ok & e[n].isNotNull()
    return q.withColumns({"valid": F.coalesce(ok, F.lit(False)), "envelope": e}).drop("_e")


def peek(queue: DataFrame, limit: int) -> DataFrame:
    """The first messages by receipt, between 1 and 10; bodies that are no envelope are left out (and stay queued)."""
    return parsed(queue.orderBy("receipt").limit(min(max(limit, PEEK[0]), PEEK[1]))).filter("valid")


def stats(queue: DataFrame) -> DataFrame:
    """How many messages are visible and how many in flight."""
    return queue.agg(F.count_if(~F.col("in_flight")).alias("visible"), F.count_if("in_flight").alias("in_flight"))


def rebuild(letters: DataFrame, now: Column, to: tuple[str, str] | None = None) -> DataFrame:
    """Events from parsed letters.  Where a letter has the event's own id and checkpoint they count, else both are the lsn; it
    happened when it was dead-lettered, or now if that can't be read.  to: another scheme and target for all."""
    e = F.col("envelope")
    at = routing.parse_prefix(e["originalPrefix"])
    scheme, target = routing.override(at["scheme"], at["target"], to)
    none = F.expr("cast(map() as map<string,string>)")
    return letters.filter("valid").select(
        "receipt", F.coalesce(e["eventId"], e["lsn"]).alias("id"), scheme.alias("scheme"), target.alias("target"), F.coalesce(e["attributes"], none).alias("attributes"),
        F.encode(e["content"], "UTF-8").alias("payload"), F.coalesce(F.try_to_timestamp(e["deadLetteredAt"]), now).alias("occurred_at"),
        F.coalesce(e["sourceCheckpoint"], e["lsn"]).alias("source_checkpoint"), F.coalesce(e["headers"], none).alias("headers"),
    )


def replay_outcome(published: Column, deleted: Column, dry_run: bool = False) -> Column:
    """What became of one letter."""
    if dry_run:
        return F.lit("dry_run")
    return F.when(~published, "publish_failed").when(~deleted, "success_delete_failed").otherwise("success")


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts of one bulk replay."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *[count(o) for o in ("success", "success_delete_failed", "publish_failed", "dry_run")])


def abandon(queue: DataFrame, receipts: DataFrame) -> DataFrame:
    """The queue without the messages of these receipts."""
    return queue.join(receipts.select("receipt").distinct(), "receipt", "left_anti")


def override_of(scheme: str | None, target: str | None) -> tuple[str, str] | None:
    """An override only if both are given and not blank."""
    return (scheme, target) if scheme and scheme.strip() and target and target.strip() else None


PUBLISHED = "receipt long, scheme string, published boolean, failure_type string, failure_message string"


def publish(events: DataFrame, registry: SinkRegistry) -> DataFrame:
    """One attempt for each rebuilt event: receipt, scheme, published, and what failed.  The frame publishes each time that
    it is computed: write it, once."""

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for event in batch.to_dict("records"):
                receipt, failure = event.pop("receipt"), None
                try:
                    registry.publish(event)
                except Exception as e:  # noqa: BLE001  a sink may raise anything
                    failure = e
                rows.append((receipt, event["scheme"], failure is None, type(failure).__name__ if failure else None, str(failure) if failure else None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PUBLISHED.split(", ")])

    return events.mapInPandas(sent, PUBLISHED)


def replayed(published: DataFrame, deleted: DataFrame) -> DataFrame:
    """receipt, scheme, outcome, failure_type, failure_message: of letters as publish() tells, and the receipts deleted."""
    gone = deleted.select("receipt", F.lit(True).alias("gone")).distinct()
    outcome = replay_outcome(F.col("published"), F.coalesce("gone", F.lit(False)))
    return published.join(gone, "receipt", "left").select("receipt", "scheme", outcome.alias("outcome"), "failure_type", "failure_message")


class TableQueue:
    """A queue as two tables in a folder: the letters, and the receipts deleted from it, which only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.letters, self.deleted = spark, f"{path}/letters", f"{path}/deleted"

    def put(self, letters: DataFrame) -> None:
        letters.select("receipt", "body", "in_flight").write.mode("append").parquet(self.letters)

    def messages(self) -> DataFrame:
        letters = self.spark.read.parquet(self.letters)
        try:
            gone = self.spark.read.parquet(self.deleted)
        except AnalysisException:  # nothing was deleted so far
            return letters
        return letters.join(gone, "receipt", "left_anti")

    def delete(self, receipts: DataFrame) -> DataFrame:
        receipts.select("receipt").write.mode("append").parquet(self.deleted)
        return receipts


class DeadLetterService:
    """What an operator does with a queue: list, count, replay one or many, abandon.  Replays are tasks of a Spark job; their
    results are written to a folder, so that each letter is published once by each call."""

    def __init__(self, queue: LetterQueue, registry: SinkRegistry, results: str):
        self.queue, self.registry, self.results = queue, registry, results

    def list(self, limit: int = PEEK[1]) -> DataFrame:
        return peek(self.queue.messages(), limit)

    def stats(self) -> dict:
        return stats(self.queue.messages()).first().asDict()

    def _replay(self, letters: DataFrame, to: tuple[str, str] | None) -> DataFrame:
        at = f"{self.results}/{uuid.uuid4().hex}"
        publish(rebuild(letters, F.current_timestamp(), to), self.registry).write.parquet(f"{at}/published")
        published = letters.sparkSession.read.parquet(f"{at}/published")
        try:
            deleted = self.queue.delete(published.filter("published").select("receipt"))
        except Exception:  # noqa: BLE001  a queue may raise anything; the letters stay
            deleted = published.limit(0).select("receipt")
        replayed(published, deleted).write.parquet(f"{at}/outcomes")
        return letters.sparkSession.read.parquet(f"{at}/outcomes")

    def replay(self, receipt: int, scheme: str | None = None, target: str | None = None) -> dict | None:
        """What became of one letter, or None if there is no such letter."""
        row = self._replay(parsed(self.queue.messages().filter(F.col("receipt") == receipt)), override_of(scheme, target)).first()
        return row.asDict() if row else None

    def replay_many(self, limit: int | None = None, dry_run: bool = False) -> dict:
        """Counts by outcome: of the first letters (1 to 10), or without a limit of all.  A dry run sends and deletes nothing."""
        letters = parsed(self.queue.messages()).filter("valid") if limit is None else self.list(limit)
        done = letters.select(replay_outcome(F.lit(True), F.lit(True), True).alias("outcome")) if dry_run else self._replay(letters, None)
        return summary(done).first().asDict()

    def abandon(self, receipt: int) -> str:
        """abandoned, or abandon_failed where the queue can't delete it."""
        try:
            self.queue.delete(self.queue.messages().filter(F.col("receipt") == receipt).select("receipt"))
        except Exception:  # noqa: BLE001
            return "abandon_failed"
        return "abandoned"
