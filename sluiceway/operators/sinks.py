"""Sinks: shaped rows for each kind of broker, the registry that resolves schemes, fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing, snapshots


class NoSinkForScheme(LookupError):
    def __init__(self, scheme: str, known: list[str]):
        super().__init__(f"no sink for scheme {scheme!r}; there are {', '.join(known) or 'none'}")
        self.scheme, self.known = scheme, known


def _attributes() -> Column:
    """Headers, and routing attributes, which win."""
    return snapshots.merged(F.col("headers"), F.col("attributes"))


def _text() -> Column:
    return F.decode("payload", "UTF-8")


def sns(events: DataFrame) -> DataFrame:
    return events.select("id", F.col("target").alias("topic"), _text().alias("body"), _attributes().alias("attributes"))


def sqs(events: DataFrame) -> DataFrame:
    return events.select("id", F.col("target").alias("queue"), _text().alias("body"), _attributes().alias("attributes"))


def kafka(events: DataFrame) -> DataFrame:
    """The columns that format("kafka") writes, with includeHeaders."""
    headers = F.transform(F.map_entries(_attributes()), lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")))
    return events.select(F.col("target").alias("topic"), F.encode("id", "UTF-8").alias("key"), F.col("payload").alias("value"), headers.alias("headers"))


def rabbitmq(events: DataFrame) -> DataFrame:
    """exchange/routing-key, split at the first slash; a bare target is a key of the default exchange."""
    at = F.position(F.lit("/"), F.col("target"))
    return events.select(
        F.when(at > 0, F.substring("target", F.lit(1), at - 1)).otherwise(F.lit("")).alias("exchange"),
        F.when(at > 0, F.substring("target", at + 1, F.char_length("target"))).otherwise(F.col("target")).alias("routing_key"),
        F.col("id").alias("message_id"), F.col("occurred_at").alias("timestamp"), _attributes().alias("headers"), F.col("payload").alias("body"),
    )


def legacy_sns(messages: DataFrame) -> DataFrame:
    """From (target, content) with the older body: topic, the body object as message, its headers as attributes."""
    body = "headers map<string,string>, body struct<eventUUID:string,eventType:string,domainId:string,domain:string,eventTimestamp:timestamp_ntz,payload:variant>"
    m = messages.withColumn("_m", F.from_json("content", body))
    return m.select(F.col("target").alias("topic"), F.to_json("_m.body").alias("message"), F.col("_m.headers").alias("attributes"), F.col("_m.body.eventType").alias("event_type"), F.col("_m.body.domainId").alias("domain_id"))


def legacy_sqs(messages: DataFrame) -> DataFrame:
    """From (target, content): queue and the content parsed and written again as JSON; null if it is none."""
    return messages.select(F.col("target").alias("queue"), F.to_json(F.try_parse_json("content")).alias("body"))


SHAPES: dict[str, Callable[[DataFrame], DataFrame]] = {"sns": sns, "sqs": sqs, "kafka": kafka, "amqp": rabbitmq}


class SinkRegistry:
    """Sinks by scheme, in any case.  A sink is a function that publishes one event (a dict) and raises if it can't."""

    def __init__(self, sinks: dict[str, Callable[[dict], None]]):
        if any(not s.strip() for s in sinks):
            raise ValueError("a scheme must not be blank")
        self.sinks = {s.lower(): f for s, f in sinks.items()}

    def resolve(self, scheme: str) -> Callable[[dict], None] | None:
        return self.sinks.get((scheme or "").lower())

    def publish(self, event: dict) -> None:
        sink = self.resolve(event["scheme"])
        if sink is None:
            raise NoSinkForScheme(event["scheme"], sorted(self.sinks))
        sink(event)

    __call__ = publish  # a registry is a sink itself


def from_config(available: dict[str, Callable[[dict], None] | None]) -> SinkRegistry:
    """A registry of the schemes whose client is there."""
    return SinkRegistry({s: f for s, f in available.items() if f is not None})


class CompositeSink:
    """Every delegate in order.  fail_fast stops at the first failure; else all are tried and the first failure is raised
    with the others as notes."""

    def __init__(self, *delegates: Callable[[dict], None], fail_fast: bool = True):
        if not delegates:
            raise ValueError("a composite needs a delegate")
        self.delegates, self.fail_fast = delegates, fail_fast

    def __call__(self, event: dict) -> None:
        failures: list[Exception] = []
        for d in self.delegates:
            try:
                d(event)
            except Exception as e:  # noqa: BLE001  a sink may raise anything
                if self.fail_fast:
                    raise
                failures.append(e)
        if failures:
            for e in failures[1:]:
                failures[0].add_note(f"suppressed: {type(e).__name__}: {e}")
            raise failures[0]


def route(events: DataFrame, schemes: list[str]) -> DataFrame:
    """events with sink (the scheme in lower case; null if there is none) and error: an invalid address, an unknown scheme."""
    known = F.lower("scheme").isin(*[s.lower() for s in schemes]) if schemes else F.lit(False)
    ok = routing.valid(F.col("scheme"), F.col("target"))
    error = F.when(~ok, "invalid routing").when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("no sink for scheme "), F.col("scheme")))
    return events.withColumn("error", error).withColumn("sink", F.when(F.col("error").isNull(), F.lower("scheme")))


def fan_out(attempts: DataFrame, fail_fast: bool = True) -> DataFrame:
    """From (event, place, delegate, ok): by event how many delegates were tried, whether all tried ones did it, and the
    first that failed."""
    failed = F.when(~F.col("ok"), F.col("place"))
    first = F.min(failed)
    out = attempts.groupBy("event").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("ok")).alias("_ok"), F.min_by("delegate", failed).alias("_by"), F.count_if(~F.col("ok")).alias("failures"))
    tried = F.when(F.col("_first").isNotNull() & F.lit(fail_fast), F.col("_first") + 1).otherwise(F.col("_n"))
    return out.select("event", tried.cast("long").alias("tried"), F.col("_first").isNull().alias("ok"), F.when(F.col("_first").isNotNull(), F.col("_by")).alias("first_failure"), F.when(F.lit(fail_fast), F.least("failures", F.lit(1))).otherwise(F.col("failures")).cast("long").alias("failures"))
