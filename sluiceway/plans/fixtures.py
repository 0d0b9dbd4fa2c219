"""Change logs, outbox rows and metric samples derived from the test tables by the same SQL in Spark and DuckDB.

Each fixture is SQL text with tables in braces; HEX stands for the engines' names of the hexadecimal function.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Changes of orders: a tenth deleted, three tenths updated, the rest inserted; the position follows the key.
CHANGES = """
select o_orderkey as k,
       case when o_orderkey % 10 = 0 then 'DELETE' when o_orderkey % 10 <= 3 then 'UPDATE' else 'INSERT' end as op,
       concat('0/', upper(HEX(cast((o_orderkey + 1) * 64 as bigint)))) as lsn,
       o_orderstatus as status, cast(round(o_totalprice * 100) as bigint) as cents, o_orderpriority as priority, o_custkey as cust
from {orders}
"""

#: Kinds of wal2json records by key: what is written for each order.
SHAPES = f"""
select c.*, case when k % 97 = 0 then 'torn' when k % 89 = 3 then 'half message' when k % 50 = 7 then 'message' when k % 83 = 5 then 'truncate'
                 when k % 79 = 2 then 'no table' when k % 71 = 4 then 'no schema' when k % 61 = 6 then 'no lsn' when k % 59 = 8 then 'no xid' else 'row' end as shape
from ({CHANGES}) c
"""

#: One transaction of three orders; how each change is written.
TRANSACTIONS = f"""
select c.*, cast(floor(k / 3) as bigint) as xid, cast(row_number() over (partition by floor(k / 3) order by k) - 1 as int) as seq,
       case when k % 7 = 1 then 'uneven values' when k % 7 = 2 then 'short types' when k % 11 = 3 then 'message' when k % 11 = 4 then 'half message' when k % 13 = 5 then 'truncate' else 'row' end as shape
from ({CHANGES}) c
"""

#: Binlog events: for each order a TABLE_MAP and a row event, now and then a ROTATE or QUERY; two sources, three tables.
BINLOG = """
select case when o_orderkey % 2 = 0 then 'server1' else 'server2' end as source, o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as cents, t.kind,
       cast(o_orderkey * 4 + t.kind as bigint) as seq, cast(case when o_orderkey % 37 = 0 and t.kind = 2 then 999 else 100 + o_orderkey % 3 end as bigint) as table_id
from {orders} cross join (values (0), (1), (2), (3)) as t(kind)
where t.kind in (1, 2) or (t.kind = 0 and (o_orderkey % 1000 < 2)) or (t.kind = 3 and o_orderkey % 5 = 0)
"""

BINLOG_EVENTS = f"""
select source, k, cents, seq, table_id, cast(100 + k * 16 + kind as bigint) as next_position, cast(1700000000000 + k * 1000 as bigint) as ts_ms,
       case when kind = 0 then 'ROTATE' when kind = 1 then 'TABLE_MAP' when kind = 3 then 'QUERY'
            when k % 10 = 0 then 'DELETE_ROWS' when k % 10 <= 2 then 'UPDATE_ROWS' else 'WRITE_ROWS' end as event_type,
       case when kind = 0 then concat('mysql-bin.', lpad(cast(cast(floor(k / 1000) as bigint) as varchar(20)), 6, '0')) end as rotate_file,
       case when k % 3 = 0 then 'orders' when k % 3 = 1 then 'items' else 'notes' end as tab
from ({BINLOG}) b
"""

#: Outbox rows from events: four ways to write the prefix, a third published.
OUTBOX = """
select event_id as id,
       case event_id % 4 when 0 then concat('Kafka://', event_type, '.events') when 1 then concat('SQS|', event_type, '|queue') when 2 then concat(event_type, '.topic') else concat('nats://', event_type) end as prefix,
       props as payload, ts as created_at, case when event_id % 3 = 0 then ts end as published_at, event_id % 7 as success_attempt
from {events}
"""

#: Metric samples: the event type chooses the series.
SAMPLES = """
select event_id, ts, case event_type when 'view' then 'messages_read' when 'click' then 'published' when 'error' then 'failed' when 'purchase' then 'dead_lettered' else 'dlq_replays' end as name,
       concat('slot', cast(user_id % 4 as varchar(9))) as slot, concat('sink', cast(user_id % 3 as varchar(9))) as sink, concat('topic', cast(event_id % 5 as varchar(9))) as topic,
       concat('cause', cast(event_id % 3 as varchar(9))) as cause, cast(event_id % 5 + 1 as varchar(9)) as attempt, case when event_id % 4 = 0 then 'success' else 'publish_failed' end as outcome,
       concat('table', cast(user_id % 5 as varchar(9))) as tab, value
from {events}
"""


def in_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql.replace("HEX(", "hex("), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def in_duckdb(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql.replace("HEX(", "to_hex("))
