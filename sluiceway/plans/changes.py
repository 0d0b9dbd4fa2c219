"""Queries of routing, mapping, wal2json and binlog decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import positions, routing
from ..model import Key, Payload, Routing, TableMapping
from ..operators import binlog, mapping, wal2json
from .catalogue import query
from .fixtures import BINLOG_EVENTS, CHANGES, OUTBOX, SHAPES, TRANSACTIONS, in_duckdb, in_spark

D_CHANGES, D_SHAPES, D_TRANSACTIONS, D_BINLOG, D_OUTBOX = map(in_duckdb, (CHANGES, SHAPES, TRANSACTIONS, BINLOG_EVENTS, OUTBOX))


def as_changes(c: DataFrame, table: str = "public.orders") -> DataFrame:
    """The fixture as row changes; deletes know only the id."""
    row = lambda *cols: F.from_json(F.to_json(F.struct(*cols)), "map<string,variant>")
    full = row(F.col("k").alias("id"), "status", F.col("cents").alias("total_cents"), "priority")
    ident, none = row(F.col("k").alias("id")), F.expr("cast(map() as map<string,variant>)")
    return c.select(
        "op", F.lit(table).alias("table"), F.col("lsn").alias("source_checkpoint"), F.lit(0).alias("seq"), F.lit(None).cast("timestamp").alias("occurred_at"),
        F.when(F.col("op") == "INSERT", none).otherwise(ident).alias("before"), F.when(F.col("op") == "DELETE", none).otherwise(full).alias("after"), "k",
    )


ORDERS = TableMapping(
    table="public.orders", capture=frozenset({"INSERT", "UPDATE"}), key=Key(("id",), "order:{id}"), payload=Payload(include=("id", "status", "total_cents"), rename={"total_cents": "totalCents"}),
    event_type="orders.{op}", routing=Routing("Kafka://orders", {"state": "{status}", "source": "db"}),
)


def _events(spark, sf_dir, *rules, serializer="json", table="public.orders"):
    return mapping.apply(as_changes(in_spark(spark, sf_dir, CHANGES), table), rules, serializer)


@query(f"""
select concat('order:', k) as id, 'kafka' as scheme, 'orders' as target, status as state, 'db' as source, case op when 'INSERT' then 'orders.created' else 'orders.updated' end as event_type,
       cast(json_object('id', k, 'status', status, 'totalCents', cents) as varchar) as payload, lsn as source_checkpoint
from ({D_CHANGES}) where op <> 'DELETE'""")
def m00_order_events(spark, sf_dir):
    """The flagship: rule look-up, capture, key format, include and rename, templates, routing."""
    e = _events(spark, sf_dir, ORDERS)
    return e.select("id", "scheme", "target", F.col("attributes.state").alias("state"), F.col("attributes.source").alias("source"), "event_type", F.decode("payload", "UTF-8").alias("payload"), "source_checkpoint")


@query(f"select lsn as id, concat('public.orders.', case op when 'INSERT' then 'created' when 'UPDATE' then 'updated' else 'deleted' end) as event_type, case when op = 'DELETE' then concat('id=', k) else concat('id=', k, chr(10), 'status=', status, chr(10), 'total_cents=', cents) end as payload from ({D_CHANGES})")
def m11_line_payloads(spark, sf_dir):
    """Snapshots (before of a delete), exclusion, the line serializer, the checkpoint as id."""
    rule = TableMapping(table="public.orders", payload=Payload(exclude=("priority",)), routing=Routing("sns://orders"))
    return _events(spark, sf_dir, rule, serializer="lines").select("id", "event_type", F.decode("payload", "UTF-8").alias("payload"))


@query(f"select concat(case when op = 'DELETE' then '' else status end, '|', k, '|') as id, case when op = 'DELETE' then concat('{{x y}}-', k, '-') else concat('{{x y}}-', k, '-', priority) end as label from ({D_CHANGES})")
def m05_joined_keys(spark, sf_dir):
    """Keys joined by a pipe with missing columns as empty text; templates with odd braces (M5, M6, M9)."""
    rule = TableMapping(table="public.orders", key=Key(("status", "id", "nothing")), routing=Routing("sns://o", {"label": "{x y}-{id}-{priority}"}))
    return _events(spark, sf_dir, rule).select("id", F.col("attributes.label").alias("label"))


@query(f"select op, cast(json_object('a', cents, 'status', status) as varchar) as payload, count(*) as n from ({D_CHANGES}) where op <> 'DELETE' group by all")
def m07_rename_collision(spark, sf_dir):
    """Two columns renamed to one name: the later value, in the place of the first (M7)."""
    rule = TableMapping(table="public.orders", capture=frozenset({"INSERT", "UPDATE"}), payload=Payload(include=("id", "status", "total_cents"), rename={"id": "a", "total_cents": "a"}), routing=Routing("sns://o"))
    c = mapping.apply(as_changes(in_spark(spark, sf_dir, CHANGES)).withColumn("op_", F.col("op")), (rule,))
    return c.groupBy(F.col("op_").alias("op"), F.decode("payload", "UTF-8").alias("payload")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
select 'public.orders' as "table", 'operation not captured' as reason, count(*) as n from ({D_CHANGES}) where op = 'DELETE'
union all select 'public.part', 'no mapping', count(*) from ({D_CHANGES}) where k < 100""")
def m14_skipped(spark, sf_dir):
    """What the rules leave out, counted."""
    c = in_spark(spark, sf_dir, CHANGES)
    return mapping.skipped(as_changes(c).unionByName(as_changes(c.filter("k < 100"), "public.part")), (ORDERS,))


@query(f"select k, op, cust from ({D_CHANGES}) where 1 = 0")
def m13_no_rules(spark, sf_dir):
    """Without rules nothing is sent."""
    c = as_changes(in_spark(spark, sf_dir, CHANGES)).withColumn("cust", F.lit(0).cast("long")).withColumn("o", F.col("op"))
    return mapping.apply(c, ()).select("k", F.col("o").alias("op"), "cust")


@query(f"""
select id, prefix, case when instr(prefix, '://') > 0 then lower(split_part(prefix, '://', 1)) when instr(prefix, '|') > 0 then lower(substring(prefix, 1, instr(prefix, '|') - 1)) else 'sns' end as scheme,
       case when instr(prefix, '://') > 0 then substring(prefix, instr(prefix, '://') + 3) when instr(prefix, '|') > 0 then substring(prefix, instr(prefix, '|') + 1) else prefix end as target
from ({D_OUTBOX})""")
def r02_prefixes(spark, sf_dir):
    """URI, piped and bare prefixes."""
    return in_spark(spark, sf_dir, OUTBOX).withColumn("r", routing.parse_prefix(F.col("prefix"))).select("id", "prefix", "r.scheme", "r.target")


@query(f"select id, case when id % 4 = 1 then null when instr(prefix, '://') > 0 then 'sns' else 'sns' end as scheme, case when id % 4 = 1 then null else prefix end as target from ({D_OUTBOX})")
def r05_legacy_prefixes(spark, sf_dir):
    """The older grammar: two pipes are an error, a URI is a topic."""
    return in_spark(spark, sf_dir, OUTBOX).withColumn("r", routing.parse_legacy_prefix(F.col("prefix"))).select("id", "r.scheme", "r.target")


@query(f"""
select id, uri, id % 5 in (0, 1) as valid, case when id % 5 in (0, 1) then concat('x', '://t', id) end as back
from (select id, case id % 5 when 0 then concat('x://t', id) when 1 then concat('X://t', id) when 2 then concat('://t', id) when 3 then concat('t', id) else 'x://' end as uri from ({D_OUTBOX}))""")
def r04_uris(spark, sf_dir):
    """Parsing, checking and writing URIs."""
    n = F.col("id").cast("string")
    uri = F.when(F.col("id") % 5 == 0, F.concat(F.lit("x://t"), n)).when(F.col("id") % 5 == 1, F.concat(F.lit("X://t"), n)).when(F.col("id") % 5 == 2, F.concat(F.lit("://t"), n)).when(F.col("id") % 5 == 3, F.concat(F.lit("t"), n)).otherwise("x://")
    d = in_spark(spark, sf_dir, OUTBOX).select("id", uri.alias("uri")).withColumn("r", routing.parse_uri(F.col("uri")))
    ok = routing.valid(F.col("r.scheme"), F.col("r.target"))
    return d.select("id", "uri", ok.alias("valid"), F.when(ok, routing.as_uri(F.col("r.scheme"), F.col("r.target"))).alias("back"))


@query(f"select id, case when id % 2 = 0 then 'kafka' else 'nats' end as scheme, case when id % 2 = 0 then 'topic-x' else 'n' end as target from ({D_OUTBOX})")
def r06_override(spark, sf_dir):
    """Another address where one is given."""
    d = in_spark(spark, sf_dir, OUTBOX)
    s, t = routing.override(F.lit("nats"), F.lit("n"), ("kafka", "topic-x"))
    o, p = routing.override(F.lit("nats"), F.lit("n"), ("kafka", " "))
    even = F.col("id") % 2 == 0
    return d.select("id", F.when(even, s).otherwise(o).alias("scheme"), F.when(even, t).otherwise(p).alias("target"))


def raw_v2(spark, sf_dir) -> DataFrame:
    """k, stream_lsn and the text of one wal2json record, format 2."""
    s, k = in_spark(spark, sf_dir, SHAPES), F.col("k").cast("string")
    col = lambda name, kind, value: F.concat(F.lit(f'{{"name":"{name}","type":"{kind}","value":'), value, F.lit("}"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    ident = col("id", "bigint", k)
    columns = F.concat(F.lit('"columns":['), ident, F.lit(","), col("status", "text", quoted(F.col("status"))), F.lit(","), col("note", "text", F.lit("null")), F.lit(","), col("total_cents", "bigint", F.col("cents").cast("string")), F.lit("]"))
    identity = F.concat(F.lit('"identity":['), ident, F.lit("]"))
    data = F.when(F.col("op") == "INSERT", columns).when(F.col("op") == "UPDATE", F.concat(columns, F.lit(","), identity)).otherwise(identity)
    shape = lambda x: F.col("shape") == x
    action = F.when(shape("message") | shape("half message"), "M").when(shape("truncate"), "T").when(F.col("k") % 4 == 1, F.lower(F.substring("op", 1, 1))).otherwise(F.substring("op", 1, 1))
    lsn = F.when(shape("no lsn"), F.lit('"lsn":"0/0",')).otherwise(F.concat(F.lit('"lsn":"'), F.col("lsn"), F.lit('",')))
    rest = (
        F.when(shape("message"), F.concat(F.lit('"prefix":"sns://t'), F.col("k") % 3, F.lit('","content":"{\\"k\\":'), k, F.lit('}"')))
        .when(shape("half message"), F.lit('"prefix":"sns://t"'))
        .otherwise(F.concat(F.when(shape("no schema"), F.lit('"schema":" ",')).otherwise(F.lit('"schema":"public",')), F.when(shape("no table"), F.lit('"table":"",')).otherwise(F.lit('"table":"orders",')), data))
    )
    xid = F.when(shape("no xid"), F.lit("")).otherwise(F.concat(F.lit('"xid":'), k, F.lit(",")))
    text = F.concat(F.lit("{"), xid, F.lit('"action":"'), action, F.lit('",'), lsn, rest, F.lit(',"unknown":1}'))
    return s.select("k", F.lit("0/FFFF").alias("stream_lsn"), F.when(shape("torn"), F.concat(F.lit('{"xid":'), k)).otherwise(text).alias("raw"))


@query(f"""
select k, case shape when 'torn' then null when 'no xid' then null when 'message' then 'message' when 'half message' then 'message' when 'truncate' then 'other' else lower(op) end as kind,
       case shape when 'torn' then 'unreadable' when 'no xid' then 'unreadable' when 'half message' then 'message without prefix or content' end as error
from ({D_SHAPES})""")
def w01_v2_kinds(spark, sf_dir):
    """Decoding format 2."""
    return wal2json.decode_v2(raw_v2(spark, sf_dir)).select("k", "kind", "error")


@query(f"""
select op, case when shape = 'no schema' then 'orders' else 'public.orders' end as "table", case when shape = 'no lsn' then '0/FFFF' else lsn end as source_checkpoint,
       case when op <> 'INSERT' then cast(k as varchar) end as before_id, case when op <> 'DELETE' then cast(k as varchar) end as after_id, case when op <> 'DELETE' then status end as status,
       case when op <> 'DELETE' then cast(json_object('id', k, 'status', status, 'note', null, 'total_cents', cents) as varchar) else '{{}}' end as after
from ({D_SHAPES}) where shape in ('row', 'no schema', 'no lsn')""")
def w14_v2_row_changes(spark, sf_dir):
    """Row changes: position, table name, ordered maps, sides."""
    r = wal2json.row_changes(wal2json.decode_v2(raw_v2(spark, sf_dir)), F.lit("0/FFFF"))
    text = lambda m, c: F.col(f"{m}.{c}").try_cast("string")
    return r.select("op", "table", "source_checkpoint", text("before", "id").alias("before_id"), text("after", "id").alias("after_id"), text("after", "status").alias("status"), F.to_json("after", {"ignoreNullFields": "false"}).alias("after"))


@query(f"""
select lsn as id, 'sns' as scheme, concat('t', k % 3) as target, concat('{{"k":', k, '}}') as payload from ({D_SHAPES}) where shape = 'message'""")
def w16_v2_message_events(spark, sf_dir):
    """Events of logical messages."""
    e = mapping.events_from_messages(wal2json.messages(wal2json.decode_v2(raw_v2(spark, sf_dir))))
    return e.select("id", "scheme", "target", F.decode("payload", "UTF-8").alias("payload"))


@query(f"""
select reason, count(*) as n from (select case shape when 'torn' then 'unreadable' when 'no xid' then 'unreadable' when 'half message' then 'message without prefix or content' when 'truncate' then 'kind other' when 'no table' then 'no table' end as reason from ({D_SHAPES}))
where reason is not null group by reason""")
def w12_dropped(spark, sf_dir):
    """Records that give nothing, by reason."""
    return wal2json.dropped(wal2json.decode_v2(raw_v2(spark, sf_dir)))


def raw_v1(spark, sf_dir) -> DataFrame:
    """xid and the text of one transaction, wal2json format 1."""
    t, k = in_spark(spark, sf_dir, TRANSACTIONS), F.col("k").cast("string")
    shape = lambda x: F.col("shape") == x
    values = F.concat(F.lit('"columnvalues":['), k, F.when(shape("uneven values"), F.lit("]")).otherwise(F.concat(F.lit(',"'), F.col("status"), F.lit('",'), F.col("cents").cast("string"), F.lit("]"))))
    types = F.when(shape("short types"), F.lit('"columntypes":["bigint"],')).otherwise(F.lit('"columntypes":["bigint","text","bigint"],'))
    columns = F.concat(F.lit('"columnnames":["id","status","total_cents"],'), types, values)
    old = F.concat(F.lit('"oldkeys":{"keynames":["id"],"keytypes":["bigint"],"keyvalues":['), k, F.lit("]}"))
    data = F.when(F.col("op") == "INSERT", columns).when(F.col("op") == "UPDATE", F.concat(columns, F.lit(","), old)).otherwise(old)
    row = F.concat(F.lit('{"kind":"'), F.when(F.col("k") % 2 == 0, F.col("op")).otherwise(F.lower("op")), F.lit('","schema":"public","table":"orders",'), data, F.lit("}"))
    text = (
        F.when(shape("message"), F.concat(F.lit('{"kind":"message","transactional":false,"prefix":"SQS|q","content":"c'), k, F.lit('"}')))
        .when(shape("half message"), F.lit('{"kind":"message","transactional":true,"prefix":"x"}'))
        .when(shape("truncate"), F.lit('{"kind":"Truncate","schema":"public","table":"orders"}'))
        .otherwise(row)
    )
    each = F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("text")))), lambda x: x["text"])
    return t.groupBy("xid").agg(each.alias("c"), F.max("lsn").alias("lsn")).select("xid", F.concat(F.lit('{"xid":'), F.col("xid").cast("string"), F.when(F.col("xid") % 5 == 0, F.lit(",")).otherwise(F.concat(F.lit(',"nextlsn":"0/A'), F.col("xid").cast("string"), F.lit('",'))), F.lit('"change":['), F.array_join("c", ","), F.lit("]}")).alias("raw"))


@query(f"""
select xid, seq, case shape when 'message' then 'message' when 'half message' then 'message' when 'truncate' then 'truncate' else lower(op) end as kind, case when xid % 5 = 0 then null else concat('0/A', xid) end as lsn,
       case when shape in ('row', 'short types') and op <> 'DELETE' then 3 else -1 end as n_columns, case when shape = 'row' and op <> 'DELETE' then 'bigint' end as first_type,
       case when shape in ('row', 'short types') and op <> 'DELETE' then cast(cents as varchar) end as cents, case when shape in ('row', 'short types', 'uneven values') and op <> 'INSERT' then cast(k as varchar) end as old_id,
       case when shape = 'message' then concat('c', k) end as content, case when shape = 'half message' then 'message without prefix, content or transactional' end as error
from ({D_TRANSACTIONS})""")
def w02_v1_changes(spark, sf_dir):
    """Decoding format 1: order, copied position, parallel arrays, message guard."""
    d = wal2json.decode_v1(raw_v1(spark, sf_dir).select("raw"))
    n = F.size("columns")
    return d.select("xid", "seq", "kind", "lsn", F.coalesce(n, F.lit(-1)).alias("n_columns"), F.get("columns", 0)["type"].alias("first_type"), F.get("columns", 2)["value"].try_cast("string").alias("cents"), F.get("identity", 0)["value"].try_cast("string").alias("old_id"), "content", "error")


@query(f"""
select k, concat(upper(to_hex(k)), '/', upper(to_hex(k * 2654435761 % 4294967296))) as lsn, cast(cast(k as hugeint) * 4294967296 + k * 2654435761 % 4294967296 as varchar) as place,
       case when k = 0 or k % 13 = 1 then 'stream' else concat(upper(to_hex(k)), '/', upper(to_hex(k * 2654435761 % 4294967296))) end as resolved
from ({D_CHANGES})""")
def w11_lsn_order(spark, sf_dir):
    """The order of positions and their fallback."""
    lsn = F.concat(F.hex("k"), F.lit("/"), F.hex(F.col("k") * 2654435761 % 4294967296))
    d = in_spark(spark, sf_dir, CHANGES).select("k", lsn.alias("lsn"))
    given = F.when(F.col("k") % 13 == 1, "").otherwise(F.col("lsn"))
    return d.select("k", "lsn", positions.lsn_order(F.col("lsn")).cast("string").alias("place"), positions.lsn_resolve(given, F.lit("stream")).alias("resolved"))


def binlog_events(spark, sf_dir) -> DataFrame:
    """The fixture in the form of model.BINLOG: three columns by row, 1 to 3 rows by event; types change at k = 5000."""
    e, v = in_spark(spark, sf_dir, BINLOG_EVENTS), lambda c: F.parse_json(c.cast("string"))
    values = lambda j, more: F.array(v(F.col("k")), v(j), v(F.col("cents") + more))
    row = lambda j: F.struct(values(j, 0).alias("before"), values(j, 1).alias("after"))
    third = F.when(F.col("k") < 5000, F.array(F.lit(8), F.lit(3), F.lit(8))).when(F.col("k") < 9000, F.array(F.lit(8), F.lit(15), F.lit(8))).otherwise(F.array(F.lit(8), F.lit(15)))
    return e.select(
        "source", "seq", "event_type", "rotate_file", "next_position", "ts_ms", "table_id", F.when(F.col("event_type") == "TABLE_MAP", "shop").alias("db"), F.when(F.col("event_type") == "TABLE_MAP", F.col("tab")).alias("table"),
        F.when(F.col("event_type") == "TABLE_MAP", third).alias("column_types"),
        F.when(F.col("event_type").endswith("_ROWS"), F.transform(F.sequence(F.lit(0), (F.col("k") % 3).cast("int")), row)).alias("rows"), "k",
    )


def catalog(spark) -> DataFrame:
    rows = [("shop", "orders", "total_cents", 3), ("shop", "orders", "id", 1), ("shop", "orders", "line", 2), ("shop", "items", "id", 1)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int")


_LOG = f"""
with e as (select *, last_value(rotate_file ignore nulls) over (partition by source order by seq) as file from ({D_BINLOG})),
m as (select *, last_value(case when event_type = 'TABLE_MAP' then tab end ignore nulls) over (partition by source, table_id order by seq) as known from e)
"""


@query(f"""{_LOG}
select case event_type when 'WRITE_ROWS' then 'INSERT' when 'UPDATE_ROWS' then 'UPDATE' else 'DELETE' end as op, concat('shop.', known) as "table", concat_ws(':', file, next_position) as source_checkpoint, cast(j as int) as seq, ts_ms,
       case when event_type = 'WRITE_ROWS' then '{{}}' else cast(case known when 'orders' then json_object('id', k, 'line', j, 'total_cents', cents) when 'items' then json_object('id', k, 'col1', j, 'col2', cents) else json_object('col0', k, 'col1', j, 'col2', cents) end as varchar) end as before,
       case when event_type = 'DELETE_ROWS' then '{{}}' else cast(case known when 'orders' then json_object('id', k, 'line', j, 'total_cents', cents + 1) when 'items' then json_object('id', k, 'col1', j, 'col2', cents + 1) else json_object('col0', k, 'col1', j, 'col2', cents + 1) end as varchar) end as after
from (select *, unnest(range(0, k % 3 + 1)) as j from m where event_type like '%\\_ROWS' escape '\\' and known is not null)""")
def b03_row_changes(spark, sf_dir):
    """Binlog rows: log file, as-of table map, names by position, positions, both images."""
    r = binlog.row_changes(binlog_events(spark, sf_dir).drop("k"), catalog(spark))
    js = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    return r.select("op", "table", "source_checkpoint", "seq", F.unix_millis("occurred_at").alias("ts_ms"), js("before"), js("after"))


@query(f"""
with t as (select source, seq, table_id, tab, case when k < 5000 then 'a' when k < 9000 then 'b' else 'c' end as types, case when k < 9000 then 3 else 2 end as n from ({D_BINLOG}) where event_type = 'TABLE_MAP'),
p as (select *, lag(types) over (partition by source, table_id order by seq) as was, lag(n) over (partition by source, table_id order by seq) as had from t)
select source, seq, table_id, was is null as first, was is not null and was <> types as drift, had is not null and had <> n as count_changed, was is null or was <> types or tab = 'notes' as refresh, tab = 'notes' as fallback from p""")
def b11_table_maps(spark, sf_dir):
    """Type drift, changed counts, look-ups and fallbacks by TABLE_MAP."""
    return binlog.table_maps(binlog_events(spark, sf_dir), catalog(spark)).select("source", "seq", "table_id", "first", "drift", "count_changed", "refresh", "fallback")


@query(f"""{_LOG} select reason, count(*) as n from (select case when event_type = 'QUERY' then 'control QUERY' when event_type like '%\\_ROWS' escape '\\' and known is null then 'unknown table id' end as reason from m) where reason is not null group by reason""")
def b12_ignored(spark, sf_dir):
    """Events that give no change."""
    return binlog.ignored(binlog_events(spark, sf_dir))


@query(f"select 'unreadable' as error, count(*) as n from ({D_BINLOG}) where k % 97 = 0 or k % 89 = 3")
def b13_unreadable(spark, sf_dir):
    """Events in JSON that can't be read, or have no type, are counted, and the others go on."""
    e = binlog_events(spark, sf_dir).drop("rows")
    text = F.to_json(F.struct(*[F.when(F.col("k") % 89 != 3, F.col(c)).alias(c) if c == "event_type" else F.col(c) for c in e.columns if c != "k"]))
    return binlog.unreadable(e.select(F.when(F.col("k") % 97 == 0, F.substring(text, 1, 20)).otherwise(text).alias("raw")))


@query(f"select seq, concat('a:b.', seq, ':', next_position) as text, concat('a:b.', seq) as file, next_position as pos, 'garbage' as bad, true as bad_is_null from ({D_BINLOG})")
def b14_positions(spark, sf_dir):
    """file:position at the last colon."""
    d = in_spark(spark, sf_dir, BINLOG_EVENTS).select("seq", F.concat(F.lit("a:b."), F.col("seq").cast("string"), F.lit(":"), F.col("next_position").cast("string")).alias("text")).withColumn("p", positions.binlog_position(F.col("text")))
    return d.select("seq", "text", "p.file", "p.pos", F.lit("garbage").alias("bad"), positions.binlog_position(F.lit("garbage")).isNull().alias("bad_is_null"))
