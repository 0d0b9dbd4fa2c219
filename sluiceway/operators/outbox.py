"""The outbox table: choosing unpublished rows, events from them, and marking them published."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing

NAME = "^[A-Za-z_][A-Za-z0-9_]*$"
MAX_BATCH = 1000


def check(table: str, batch: int) -> None:
    """Refuse a table name that is no plain identifier, and a batch outside 1 to 1000."""
    if not re.fullmatch(NAME[1:-1], table):
        raise ValueError(f"not a table name: {table!r}")
    if not 1 <= batch <= MAX_BATCH:
        raise ValueError(f"the batch must be between 1 and {MAX_BATCH}")


def name_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME) & ~name.contains("\n"), F.lit(False))


def pending(outbox: DataFrame, batch: int = 1) -> DataFrame:
    """The first unpublished rows by id, at most a batch."""
    check("outbox", batch)
    return outbox.filter("published_at is null").orderBy("id").limit(batch)


def events(rows: DataFrame, map_headers: bool = False) -> DataFrame:
    """Events from outbox rows: the id as text is id and checkpoint, created_at is when it happened."""
    to = routing.parse_prefix(F.col("prefix"))
    none = F.expr("cast(map() as map<string,string>)")
    headers = F.coalesce(F.from_json("headers", "map<string,string>"), none) if map_headers else none
    ident = F.col("id").cast("string")
    return rows.select(
        ident.alias("id"), to["scheme"].alias("scheme"), to["target"].alias("target"), none.alias("attributes"), F.encode("payload", "UTF-8").alias("payload"),
        F.lit(None).cast("string").alias("event_type"), F.col("created_at").alias("occurred_at"), ident.alias("source_checkpoint"), headers.alias("headers"),
    )


def mark_published(outbox: DataFrame, delivered: DataFrame, at: Column) -> DataFrame:
    """The outbox with published_at set on the delivered ids that had none."""
    done = delivered.select(F.col("id").try_cast("bigint").alias("id")).dropna().distinct().withColumn("_done", F.lit(True))
    return outbox.join(done, "id", "left").withColumn("published_at", F.when(F.col("_done") & F.col("published_at").isNull(), at).otherwise(F.col("published_at"))).drop("_done")
