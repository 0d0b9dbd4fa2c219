"""Schemas of the change-event data model and the rule classes that users declare.

Rules are plan-time constants: they are checked when they are made and compiled to Column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

OPS = ("INSERT", "UPDATE", "DELETE")

EVENT = (
    "id string, scheme string, target string, attributes map<string,string>, payload binary, event_type string, "
    "occurred_at timestamp, source_checkpoint string, headers map<string,string>"
)
ROW_CHANGE = "op string, table string, source_checkpoint string, seq int, occurred_at timestamp, before map<string,variant>, after map<string,variant>"
WAL_COLUMN = "array<struct<name:string,type:string,value:variant>>"
WAL_V2 = f"xid bigint, action string, prefix string, content string, lsn string, `schema` string, `table` string, columns {WAL_COLUMN}, identity {WAL_COLUMN}, _bad string"
WAL_V1 = (
    "xid bigint, nextlsn string, change array<struct<kind:string,schema:string,table:string,columnnames:array<string>,columntypes:array<string>,columnvalues:array<variant>,"
    "oldkeys:struct<keynames:array<string>,keytypes:array<string>,keyvalues:array<variant>>,transactional:boolean,prefix:string,content:string>>, _bad string"
)
BINLOG = (
    "source string, seq bigint, event_type string, rotate_file string, next_position bigint, ts_ms bigint, table_id bigint, db string, `table` string, "
    "column_types array<int>, rows array<struct<before:array<variant>,after:array<variant>>>"
)
OUTBOX = "id bigint, prefix string, payload string, headers string, created_at timestamp, published_at timestamp"
ENVELOPE = "originalPrefix string, lsn string, content string, failureType string, failureMessage string, deadLetteredAt string"
#: What the envelope has beside its six fields, so that a replayed event keeps its identity.
ENVELOPE_MORE = "eventId string, sourceCheckpoint string, headers map<string,string>, attributes map<string,string>"


@dataclass(frozen=True)
class Key:
    """Event id: the columns joined by a pipe, or a format with {column} places; without columns the checkpoint."""

    columns: tuple[str, ...] = ()
    format: str | None = None


@dataclass(frozen=True)
class Payload:
    """Which columns of a row are sent: all, only include, or all but exclude; then rename."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.include and self.exclude:
            raise ValueError("payload: include and exclude can't both be set")


@dataclass(frozen=True)
class Routing:
    """Where events go: scheme://target, and attributes with {column} places."""

    sink: str
    attributes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.sink.find("://") < 1:
            raise ValueError(f"routing: the sink must look like scheme://target, not {self.sink!r}")


@dataclass(frozen=True)
class TableMapping:
    """What becomes of the changes of one table."""

    table: str
    routing: Routing
    capture: frozenset[str] = frozenset(OPS)
    key: Key = Key()
    payload: Payload = Payload()
    event_type: str = "{table}.{op}"

    def __post_init__(self):
        if not self.table.strip():
            raise ValueError("mapping: the table must not be blank")
        if not self.capture or set(self.capture) - set(OPS):
            raise ValueError(f"mapping: capture must be some of {OPS}")


def mappings_from_config(config: list[dict]) -> tuple[TableMapping, ...]:
    """Rules from plain dictionaries, as a configuration file has them."""
    out = []
    for c in config:
        key, payload, routing = c.get("key", {}), c.get("payload", {}), c["routing"]
        out.append(
            TableMapping(
                table=c["table"],
                capture=frozenset(str(x).upper() for x in c.get("capture", OPS)),
                key=Key(tuple(key.get("columns", ())), key.get("format")),
                payload=Payload(tuple(payload.get("include", ())), tuple(payload.get("exclude", ())), dict(payload.get("rename", {}))),
                event_type=c.get("event_type", "{table}.{op}"),
                routing=Routing(routing["sink"], dict(routing.get("attributes", {}))),
            )
        )
    return checked(tuple(out))


def checked(rules: tuple[TableMapping, ...]) -> tuple[TableMapping, ...]:
    """The rules, if no table has two of them."""
    tables = [r.table for r in rules]
    twice = sorted({t for t in tables if tables.count(t) > 1})
    if twice:
        raise ValueError(f"more than one mapping for {', '.join(twice)}")
    return tuple(rules)
