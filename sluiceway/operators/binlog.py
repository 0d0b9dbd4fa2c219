"""Binlog events to row changes.

Input is one row per event (see model.BINLOG), seq being the place in its source's log.  Log files and table maps are
carried forward block by block (functions.carry), so that a source or table with most of the rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.carry import BLOCK, carry_forward
from ..functions.parse import with_parsed

ROWS = {"WRITE_ROWS": "INSERT", "UPDATE_ROWS": "UPDATE", "DELETE_ROWS": "DELETE"}


def with_file(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """The log file of each event: that of the last ROTATE before it in its source."""
    return carry_forward(events, ["source"], "seq", F.col("rotate_file"), "file", block=block)


def with_table_map(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """db, table and column_types of each row event from the last TABLE_MAP of its id before it; null if there is none."""
    known = F.when(F.col("event_type") == "TABLE_MAP", F.struct("db", "table", "column_types", F.col("seq").alias("map_seq")))
    return carry_forward(events, ["source", "table_id"], "seq", known, "map", block=block)


def table_maps(events: DataFrame, catalog: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Each TABLE_MAP event with what it changes: first (no map of this id before), drift (other type codes than the one
    before; never at the first), refresh (names are looked up: first, drift, or the last look-up found none), names (of the
    catalog by position, null if there are none) and fallback (a look-up found none)."""
    maps = events.filter("event_type = 'TABLE_MAP'").select("source", "seq", "table_id", "db", "table", "column_types")
    maps = carry_forward(maps, ["source", "table_id"], "seq", F.col("column_types"), "before", strict=True, block=block)
    maps = maps.withColumns(
        {
            "first": F.col("before").isNull(),
            "drift": F.col("before").isNotNull() & (F.col("before") != F.col("column_types")),
            "count_changed": F.col("before").isNotNull() & (F.size("before") != F.size("column_types")),
        }
    ).drop("before")
    if catalog is None:
        return maps.withColumns({"names": F.lit(None).cast("array<string>"), "refresh": F.lit(True), "fallback": F.lit(True)})
    maps = maps.join(catalog_names(catalog), ["db", "table"], "left")
    refresh = F.col("first") | F.col("drift") | F.col("names").isNull()
    return maps.withColumns({"refresh": refresh, "fallback": F.col("names").isNull()})


def catalog_names(catalog: DataFrame) -> DataFrame:
    """Column names in order for each (db, table), from (table_schema, table_name, column_name, ordinal_position)."""
    return catalog.groupBy(F.col("table_schema").alias("db"), F.col("table_name").alias("table")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))), lambda x: x["column_name"]).alias("names")
    )


def named(values: Column, names: Column) -> Column:
    """Values by position as a map; a position without a name is called col and its number."""
    entry = lambda v, i: F.struct(F.coalesce(F.get(names, i), F.concat(F.lit("col"), i.cast("string"))).alias("key"), v.alias("value"))
    return F.coalesce(F.map_from_entries(F.transform(values, entry)), F.expr("cast(map() as map<string,variant>)"))


def row_changes(events: DataFrame, catalog: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row change for each row of each WRITE, UPDATE and DELETE event: op, table (db.table), source_checkpoint
    (file:next position, the same for all rows of an event), seq (place among them), occurred_at, before, after.

    Rows of a table id that no TABLE_MAP announced are left out, as are control events.  Without a catalog entry the
    columns are called by number."""
    return mapped_changes(with_table_map(with_file(events, block), block), catalog)


def mapped_changes(events: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """The same from events that have their file and map already."""
    e = events.filter(F.col("event_type").isin(*ROWS) & F.col("map").isNotNull())
    e = e.select("source", "event_type", F.concat_ws(":", "file", "next_position").alias("source_checkpoint"), F.timestamp_millis("ts_ms").alias("occurred_at"), F.col("map.db").alias("db"), F.col("map.table").alias("table"), "rows", F.col("seq").alias("log_seq"))
    if catalog is None:
        e = e.withColumn("names", F.lit(None).cast("array<string>"))
    else:
        e = e.join(catalog_names(catalog), ["db", "table"], "left")
    op = F.when(F.col("event_type") == "WRITE_ROWS", "INSERT").when(F.col("event_type") == "UPDATE_ROWS", "UPDATE").otherwise("DELETE")
    e = e.select("*", F.posexplode("rows").alias("seq", "r"))
    none = F.expr("cast(array() as array<variant>)")
    return e.select(
        op.alias("op"), F.concat_ws(".", "db", "table").alias("table"), "source_checkpoint", "seq", "occurred_at",
        named(F.when(op == "INSERT", none).otherwise(F.col("r.before")), F.col("names")).alias("before"),
        named(F.when(op == "DELETE", none).otherwise(F.col("r.after")), F.col("names")).alias("after"),
        "source", "log_seq",
    )


def ignored(events: DataFrame) -> DataFrame:
    """How many events give no row change, by reason."""
    e = with_table_map(events)
    reason = F.when(~F.col("event_type").isin(*ROWS, "ROTATE", "TABLE_MAP"), F.concat(F.lit("control "), F.col("event_type"))).when(F.col("event_type").isin(*ROWS) & F.col("map").isNull(), "unknown table id")
    return e.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def parse(raw: DataFrame, column: str = "raw", keep: bool = False) -> DataFrame:
    """Binlog events from JSON text, with error for those that can't be read; the others go on.  keep: with raw's columns."""
    from ..model import BINLOG

    r = with_parsed(raw, column, BINLOG + ", _bad string", "_r")
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | F.col("_r.event_type").isNull()
    return r.select(*(raw.columns if keep else []), F.when(bad, "unreadable").alias("error"), "_r.*").drop("_bad")


def unreadable(raw: DataFrame, column: str = "raw") -> DataFrame:
    """How many events can't be read, by error; the stream goes on without them."""
    return parse(raw, column).filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))
