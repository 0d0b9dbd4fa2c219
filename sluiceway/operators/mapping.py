"""Row changes to events by declared rules.  One narrow pass: all rules are one chain of conditions on the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing, snapshots
from ..model import EVENT, TableMapping, checked

ACTIONS = {"INSERT": "created", "UPDATE": "updated", "DELETE": "deleted"}


def action(op: Column) -> Column:
    return reduce(lambda c, kv: c.when(op == kv[0], kv[1]), list(ACTIONS.items())[1:], F.when(op == "INSERT", ACTIONS["INSERT"]))


def event_type(template: str, op: Column, table: Column) -> Column:
    """The template with {table} and {op} replaced; other places stay."""
    return F.replace(F.replace(F.lit(template), F.lit("{table}"), table), F.lit("{op}"), action(op))


def snapshot() -> Column:
    """The row as it is now: after an insert or update, before a delete."""
    return F.when(F.col("op") == "DELETE", F.col("before")).otherwise(F.col("after"))


def event_id(rule: TableMapping, row: Column) -> Column:
    if not rule.key.columns:
        return F.col("source_checkpoint")
    return snapshots.template(rule.key.format, row) if rule.key.format is not None else snapshots.joined(row, rule.key.columns)


def accepted(rules: tuple[TableMapping, ...]) -> Column:
    """Whether a change has a rule that captures its operation."""
    each = [(F.col("table") == r.table) & F.col("op").isin(*sorted(r.capture)) for r in rules]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def apply(changes: DataFrame, rules: tuple[TableMapping, ...], serializer: str = "json") -> DataFrame:
    """Events from row changes (op, table, source_checkpoint, occurred_at, before, after; others pass through as they are,
    after the event's own).  Changes without a rule, or of an operation that it doesn't capture, give nothing.

    serializer: json, or lines for name=value lines.  A rule's target, key and templates are worked out when the plan is made.
    """
    rules = checked(tuple(rules))
    own = ["op", "table", "source_checkpoint", "occurred_at", "before", "after"]
    rest = [c for c in changes.columns if c not in own]
    if not rules:
        names = [x.strip().split()[0] for x in EVENT.split(", ")]
        empty = changes.sparkSession.createDataFrame([], EVENT)
        return empty.select(*names, *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in rest])
    write = {"json": snapshots.as_json, "lines": snapshots.as_lines}[serializer]
    row = F.col("_row")

    def choose(make) -> Column:
        return reduce(lambda c, r: c.when(F.col("table") == r.table, make(r)), rules[1:], F.when(F.col("table") == rules[0].table, make(rules[0])))

    def attributes(r: TableMapping) -> Column:
        items = [x for k, t in r.routing.attributes.items() for x in (F.lit(k), snapshots.template(t, row))]
        return F.create_map(*items) if items else F.expr("cast(map() as map<string,string>)")

    kind = choose(lambda r: event_type(r.event_type, F.col("op"), F.col("table")))
    return (
        changes.filter(accepted(rules))
        .withColumn("_row", snapshot())
        .select(
            choose(lambda r: event_id(r, row)).alias("id"),
            choose(lambda r: F.lit(r.routing.sink[: r.routing.sink.index("://")].lower())).alias("scheme"),
            choose(lambda r: F.lit(r.routing.sink[r.routing.sink.index("://") + 3 :])).alias("target"),
            choose(attributes).alias("attributes"),
            F.encode(choose(lambda r: write(snapshots.project(row, r.payload.include, r.payload.exclude, r.payload.rename))), "UTF-8").alias("payload"),
            kind.alias("event_type"),
            "occurred_at",
            "source_checkpoint",
            F.create_map(F.lit("eventType"), kind).alias("headers"),
            *rest,
        )
    )


def skipped(changes: DataFrame, rules: tuple[TableMapping, ...]) -> DataFrame:
    """How many changes the rules leave out, by table and reason.  Their positions count as done."""
    known = F.col("table").isin(*[r.table for r in rules]) if rules else F.lit(False)
    return (
        changes.filter(~accepted(checked(tuple(rules))))
        .groupBy("table", F.when(known, "operation not captured").otherwise("no mapping").alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def events_from_messages(messages: DataFrame, occurred_at: Column | None = None) -> DataFrame:
    """Events from logical messages (prefix, content, lsn): the prefix addresses, the position is the id.  A prefix that
    can't be parsed gives an event without a valid address; delivery sets it aside."""
    to = routing.parse_prefix(F.col("prefix"))
    none = F.expr("cast(map() as map<string,string>)")
    return messages.select(
        F.col("lsn").alias("id"), to["scheme"].alias("scheme"), to["target"].alias("target"), none.alias("attributes"), F.encode("content", "UTF-8").alias("payload"),
        F.lit(None).cast("string").alias("event_type"), (occurred_at if occurred_at is not None else F.current_timestamp()).alias("occurred_at"), F.col("lsn").alias("source_checkpoint"), none.alias("headers"),
    )
