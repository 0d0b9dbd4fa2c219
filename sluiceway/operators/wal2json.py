"""Decoding wal2json text, formats 2 and 1, into records and row changes.  All steps are narrow: nothing is shuffled.

A decoded record has: kind (insert, update, delete, message or the source's own name for others), xid, lsn, seq (place
among the records of one text), schema, table, columns, identity, prefix, content, transactional and error (why the text
or record can't be used; null if it can).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import positions
from ..functions.parse import with_parsed
from ..functions.snapshots import last_wins
from ..model import WAL_COLUMN, WAL_V1, WAL_V2

KINDS = {"I": "insert", "U": "update", "D": "delete"}


def decode_v2(raw: DataFrame, column: str = "raw") -> DataFrame:
    """One record from each text.  Action M exactly is a message (always transactional) and needs prefix and content; I,
    U and D count in either case; any other action is kind other.  Without xid or action a record is an error."""
    d = with_parsed(raw, column, WAL_V2, "_r")
    r = F.col("_r")
    bad = r.isNull() | r["_bad"].isNotNull() | r["xid"].isNull() | r["action"].isNull()
    message = r["action"] == "M"
    torn = message & (r["prefix"].isNull() | r["content"].isNull())
    kind = F.when(message, "message")
    for letter, name in KINDS.items():
        kind = kind.when(F.upper(r["action"]) == letter, name)
    return d.select(
        *[c for c in raw.columns if c != column],
        F.when(~bad, kind.otherwise("other")).alias("kind"),
        r["xid"].alias("xid"), r["lsn"].alias("lsn"), F.lit(0).alias("seq"), r["schema"].alias("schema"), r["table"].alias("table"),
        r["columns"].alias("columns"), r["identity"].alias("identity"), r["prefix"].alias("prefix"), r["content"].alias("content"),
        message.alias("transactional"),
        F.when(bad, "unreadable").when(torn, "message without prefix or content").alias("error"),
    )


def zipped(names: Column, types: Column, values: Column) -> Column:
    """Parallel arrays as an array of (name, type, value).  Unequal numbers of names and values give null; a number of
    types that differs only drops the types."""
    typed = F.size(types) == F.size(names)
    row = lambda n, i: F.struct(n.alias("name"), F.when(typed, F.get(types, i)).alias("type"), F.get(values, i).alias("value"))
    return F.when(F.size(names) == F.size(values), F.transform(names, row))


def decode_v1(raw: DataFrame, column: str = "raw") -> DataFrame:
    """A record from each entry of a transaction's change list, in order, with the transaction's position.  Kinds are in
    lower case; a message without prefix, content or transactional has kind message and no content."""
    d = with_parsed(raw, column, WAL_V1, "_r")
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | F.col("_r.xid").isNull() | F.col("_r.change").isNull()
    d = d.withColumn("_error", F.when(bad, "unreadable"))
    d = d.select("*", F.posexplode_outer(F.when(~bad, F.col("_r.change"))).alias("seq", "_c")).filter("_error is not null or _c is not null")
    c = F.col("_c")
    kind = F.lower(c["kind"])
    whole = c["prefix"].isNotNull() & c["content"].isNotNull() & c["transactional"].isNotNull()
    message = (kind == "message") & whole
    keys = c["oldkeys"]
    return d.select(
        *[x for x in raw.columns if x != column],
        kind.alias("kind"), F.col("_r.xid").alias("xid"), F.col("_r.nextlsn").alias("lsn"), F.coalesce("seq", F.lit(0)).alias("seq"), c["schema"].alias("schema"), c["table"].alias("table"),
        zipped(c["columnnames"], c["columntypes"], c["columnvalues"]).cast(WAL_COLUMN).alias("columns"),
        zipped(keys["keynames"], keys["keytypes"], keys["keyvalues"]).cast(WAL_COLUMN).alias("identity"),
        F.when(message, c["prefix"]).alias("prefix"), F.when(message, c["content"]).alias("content"), F.when(message, c["transactional"]).alias("transactional"),
        F.when(F.col("_error").isNotNull(), F.col("_error")).when((kind == "message") & ~whole, "message without prefix, content or transactional").alias("error"),
    )


def decode(raw: DataFrame, version: str = "V2", column: str = "raw") -> DataFrame:
    """By format version, V1 or V2."""
    forms = {"V1": decode_v1, "V2": decode_v2}
    if version.upper() not in forms:
        raise ValueError(f"no wal2json format {version!r}; there are {sorted(forms)}")
    return forms[version.upper()](raw, column)


def as_map(columns: Column) -> Column:
    """A record's columns as an ordered map; of columns with one name the last counts."""
    entries = F.transform(columns, lambda c: F.struct(c["name"].alias("key"), c["value"].alias("value")))
    return F.coalesce(F.map_from_entries(F.transform(F.array(entries), last_wins)[0]), F.expr("cast(map() as map<string,variant>)"))


def table_name(schema: Column, table: Column) -> Column:
    """schema.table; the bare table if the schema is blank; null if the table is."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.when(blank(table), None).when(blank(schema), table).otherwise(F.concat_ws(".", schema, table))


def row_changes(records: DataFrame, stream_lsn: Column | None = None, occurred_at: Column | None = None) -> DataFrame:
    """Inserts, updates and deletes as row changes.  before is the identity (updates, deletes), after the columns (inserts,
    updates), each an empty map where there is none.  Records without a table are left out; see dropped()."""
    op = F.when(F.col("kind") == "insert", "INSERT").when(F.col("kind") == "update", "UPDATE").when(F.col("kind") == "delete", "DELETE")
    empty = F.expr("cast(map() as map<string,variant>)")
    lsn = positions.lsn_resolve(F.col("lsn"), stream_lsn if stream_lsn is not None else F.lit(None).cast("string"))
    out = records.filter("error is null").select(
        op.alias("op"), table_name(F.col("schema"), F.col("table")).alias("table"), lsn.alias("source_checkpoint"), "seq",
        (occurred_at if occurred_at is not None else F.current_timestamp()).alias("occurred_at"),
        F.when(op == "INSERT", empty).otherwise(as_map(F.col("identity"))).alias("before"),
        F.when(op == "DELETE", empty).otherwise(as_map(F.col("columns"))).alias("after"),
    )
    return out.filter("op is not null and table is not null")


def messages(records: DataFrame) -> DataFrame:
    """Usable messages: prefix, content, lsn, seq.  All of a transaction, not only the first."""
    return records.filter("kind = 'message' and error is null").select("prefix", "content", "lsn", "seq")


def dropped(records: DataFrame) -> DataFrame:
    """How many records give neither row change nor message, by reason."""
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("kind").isin("insert", "update", "delete", "message"), F.concat(F.lit("kind "), F.col("kind")))
        .when((F.col("kind") != "message") & table_name(F.col("schema"), F.col("table")).isNull(), "no table")
    )
    return records.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
