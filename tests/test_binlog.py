import json

import pytest
from pyspark.sql import functions as F

from sluiceway.functions.carry import carry_forward
from sluiceway.model import BINLOG
from sluiceway.operators import binlog


def log(spark, *events):
    base = {"source": "s", "next_position": 100, "ts_ms": 1700000000000}
    rows = [(json.dumps(base | {"seq": i} | e),) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "raw string").select(F.from_json("raw", BINLOG).alias("e")).select("e.*")


def table_map(types, table_id=1, table="orders"):
    return {"event_type": "TABLE_MAP", "table_id": table_id, "db": "shop", "table": table, "column_types": types}


def catalog(spark, *names):
    return spark.createDataFrame([("shop", "orders", n, len(names) - i) for i, n in enumerate(reversed(names))], "table_schema string, table_name string, column_name string, ordinal_position int")


def rows(kind, *pairs, table_id=1, **more):
    return {"event_type": kind, "table_id": table_id, "rows": [{"before": b, "after": a} for b, a in pairs]} | more


def maps(spark, cat, *types, block=2):
    r = binlog.table_maps(log(spark, *[table_map(t) for t in types]), cat, block).orderBy("seq").collect()
    return [x.drift for x in r], [x.refresh for x in r], [x.fallback for x in r], [x.count_changed for x in r]


def test_drift_and_lookups(spark):
    c = catalog(spark, "id", "status")
    assert maps(spark, c, [3, 15], [3, 15, 4])[:2] == ([False, True], [True, True])
    assert maps(spark, c, [3, 15], [3, 15], [3, 15])[:2] == ([False] * 3, [True, False, False])
    drift, refresh, fallback, count = maps(spark, c, [3, 15, 4], [8, 15, 4])
    assert (drift, refresh, fallback, count) == ([False, True], [True, True], [False, False], [False, False])
    none = catalog(spark).limit(0)
    assert maps(spark, none, [3], [3])[1:3] == ([True, True], [True, True])
    assert binlog.catalog_names(catalog(spark, "id", "status", "total_cents")).first().names == ["id", "status", "total_cents"]


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_row_changes(spark, block):
    e = log(
        spark,
        rows("WRITE_ROWS", (None, [0])), {"event_type": "ROTATE", "rotate_file": "bin.1"}, table_map([3, 15]),
        rows("WRITE_ROWS", (None, [1, "a"]), (None, [2, None, 5]), next_position=200), rows("UPDATE_ROWS", ([1, "a"], [1, "b"])), {"event_type": "QUERY"},
        {"event_type": "ROTATE", "rotate_file": "bin.2"}, rows("DELETE_ROWS", ([1, "b"], None)), rows("WRITE_ROWS", (None, [9]), table_id=5), table_map([3], 5, "other"), rows("WRITE_ROWS", (None, [9]), table_id=5),
    )
    js = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    got = binlog.row_changes(e, catalog(spark, "id", "status"), block).orderBy("log_seq", "seq").select("op", "table", "source_checkpoint", "seq", js("before"), js("after")).collect()
    assert [tuple(r) for r in got] == [
        ("INSERT", "shop.orders", "bin.1:200", 0, "{}", '{"id":1,"status":"a"}'), ("INSERT", "shop.orders", "bin.1:200", 1, "{}", '{"id":2,"status":null,"col2":5}'),
        ("UPDATE", "shop.orders", "bin.1:100", 0, '{"id":1,"status":"a"}', '{"id":1,"status":"b"}'), ("DELETE", "shop.orders", "bin.2:100", 0, '{"id":1,"status":"b"}', "{}"), ("INSERT", "shop.other", "bin.2:100", 0, "{}", '{"col0":9}'),
    ]
    assert {r.reason: r.n for r in binlog.ignored(e).collect()} == {"unknown table id": 2, "control QUERY": 1}


def test_unreadable_events_are_set_aside(spark):
    raw = spark.createDataFrame([('{"event_type":"QUERY","seq":1}',), ("{",), ("{}",)], "raw string")
    assert sorted((r.error or "", r.event_type or "") for r in binlog.parse(raw).collect()) == [("", "QUERY"), ("unreadable", ""), ("unreadable", "")]


@pytest.mark.parametrize("block", [1, 2, 7, 100])
@pytest.mark.parametrize("strict", [False, True])
def test_carry_forward(spark, block, strict):
    values = {("a", 1): "x", ("a", 9): "y", ("b", 4): "z", (None, 3): "n"}
    keys = [(g, i) for g in ("a", "b", None) for i in range(0, 14, 1 if g == "a" else 2)]
    keys += [k for k in values if k not in keys]
    d = spark.createDataFrame([(g, i, values.get((g, i))) for g, i in keys], "g string, i long, v string")
    got = {(r.g, r.i): r.c for r in carry_forward(d.filter("g is not null"), ["g"], "i", F.col("v"), "c", strict, block).collect()}
    for g, i in got:
        before = [j for j in range(i + (not strict)) if (g, j) in values]
        assert got[g, i] == (values[g, before[-1]] if before else None)
    assert len(got) == len([k for k in keys if k[0]])
