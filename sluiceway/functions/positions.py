"""Log positions as Column expressions: Postgres LSNs, binlog file:position pairs, checkpoint keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LSN = "^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"


def lsn_order(lsn: Column) -> Column:
    """A number in the order of positions, DECIMAL(20,0) as the largest pass a signed long; null if malformed."""
    part = lambda i: F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return F.when(lsn.rlike(LSN), (part(1) * F.lit(4294967296).cast("decimal(20,0)") + part(2)).cast("decimal(20,0)"))


def lsn_valid(lsn: Column) -> Column:
    """Well-formed and not the invalid position 0/0."""
    return F.coalesce(lsn_order(lsn) > 0, F.lit(False))


def lsn_resolve(lsn: Column, fallback: Column) -> Column:
    """The record's position if it is valid, else that of the stream."""
    return F.when(lsn_valid(lsn), lsn).otherwise(fallback)


def binlog_position(text: Column) -> Column:
    """struct(file, pos) from file:pos, split at the last colon; null if malformed.  Structs compare in log order, file
    names as text (so a rollover to a longer number sorts wrong, as text does)."""
    pattern = "^(.+):([0-9]+)$"
    pos = F.regexp_extract(text, pattern, 2).try_cast("bigint")
    return F.when(text.rlike(pattern) & pos.isNotNull(), F.struct(F.regexp_extract(text, pattern, 1).alias("file"), pos.alias("pos")))


def checkpoint_key(kind: Column, name: Column) -> Column:
    """binlog:<server id> or pg-wal:<slot>."""
    return F.concat(kind, F.lit(":"), name)


def checkpoint_file_name(key: Column) -> Column:
    """A key as a file name: letters, digits, dots and hyphens stay, all else becomes an underscore."""
    return F.regexp_replace(key, "[^\\p{L}\\p{Nd}.\\-]", "_")
