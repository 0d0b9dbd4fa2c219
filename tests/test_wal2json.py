import json

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import deadletters, mapping, wal2json


def raw(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "raw string").coalesce(1)


def text(m):
    return F.to_json(m, {"ignoreNullFields": "false"})


def changes(spark, version, *records, stream=None):
    r = wal2json.row_changes(wal2json.decode(raw(spark, *records), version), F.lit(stream).cast("string"))
    return [tuple(x) for x in r.select("op", "table", "source_checkpoint", "seq", text(F.col("before")), text(F.col("after"))).collect()]


def fields(**values):
    """Columns in format 2, the types those of a depot's shelves."""
    kinds = {str: "varchar", int: "smallint", float: "real", type(None): "date"}
    return [{"name": n, "type": kinds[type(v)], "value": v} for n, v in values.items()]


def shelf(action, lsn="2/C0FFEE", **more):
    return {"xid": 31, "action": action, "lsn": lsn, "schema": "depot", "table": "shelves"} | more


def test_v2_inserts_updates_deletes(spark):
    got = changes(
        spark, "V2",
        shelf("I", columns=fields(code="B-7", grams=1250)),
        shelf("U", "2/C0FFEF", columns=[{"name": "code", "value": "B-7"}, {"name": "grams", "value": 980}], identity=[{"name": "code", "value": "B-7"}]),
        shelf("D", "3/0", identity=fields(code="B-7")),
    )
    assert got == [
        ("INSERT", "depot.shelves", "2/C0FFEE", 0, "{}", '{"code":"B-7","grams":1250}'),
        ("UPDATE", "depot.shelves", "2/C0FFEF", 0, '{"code":"B-7"}', '{"code":"B-7","grams":980}'),
        ("DELETE", "depot.shelves", "3/0", 0, '{"code":"B-7"}', "{}"),
    ]


def test_v2_records_that_give_no_row(spark):
    none = [shelf("M", prefix="kafka://depot", content="[]"), shelf("I", table=""), {"xid": 31, "action": "I"}, shelf("B"), shelf("C"), "[", shelf("T")]
    assert changes(spark, "V2", *none) == []


def test_v2_small_letters_blank_schema_and_repeated_columns(spark):
    odd = shelf("i", schema=" ", columns=fields(w=4) + fields(w=6) + fields(seen=None))
    assert changes(spark, "V2", odd) == [("INSERT", "shelves", "2/C0FFEE", 0, "{}", '{"w":6,"seen":null}')]


@pytest.mark.parametrize(
    "record, kind, error",
    [
        ({"xid": 5, "action": "M", "prefix": "kafka://depot", "content": "[]", "lsn": "2/1"}, "message", None),
        ({"xid": 5, "action": "M", "prefix": "kafka://depot"}, "message", "message without prefix or content"),
        ({"xid": 5, "action": "M", "content": "[]"}, "message", "message without prefix or content"),
        ({"xid": 5, "action": "m"}, "other", None),
        ({"xid": 5, "action": "D"}, "delete", None),
        ({"xid": 5, "action": "T"}, "other", None),
        ({"action": "I"}, None, "unreadable"),
        ({"xid": 5}, None, "unreadable"),
        ('{"xid":5,"act', None, "unreadable"),
        ("", None, "unreadable"),
    ],
)
def test_v2_kinds(spark, record, kind, error):
    r = wal2json.decode_v2(raw(spark, record)).first()
    assert (r.kind, r.error) == (kind, error) and r.transactional in (kind == "message", None)


def test_v2_reasons_are_counted(spark):
    d = wal2json.decode_v2(raw(spark, "{", "{", {"xid": 1, "action": "M"}, {"xid": 1, "action": "T"}, {"xid": 1, "action": "I"}, shelf("I")))
    assert {r.reason: r.n for r in wal2json.dropped(d).collect()} == {"unreadable": 2, "message without prefix or content": 1, "kind other": 1, "no table": 1}


def v1(kind, **more):
    return {"kind": kind, "schema": "depot", "table": "shelves"} | more


NEW = {"columnnames": ["code", "grams", "row"], "columntypes": ["varchar", "smallint", "real"], "columnvalues": ["B-7", 1250, 2.5]}
OLD = {"oldkeys": {"keynames": ["code"], "keytypes": ["varchar"], "keyvalues": ["B-7"]}}


def transaction(*change, lsn="4/AB", xid=90):
    return {"xid": xid, "change": list(change)} | ({"nextlsn": lsn} if lsn else {})


def test_v1_changes_have_the_position_of_their_transaction(spark):
    t = transaction(v1("insert", **NEW), v1("UPDATE", **NEW, **OLD), v1("truncate"), v1("delete", **OLD))
    full = '{"code":"B-7","grams":1250,"row":2.5}'
    assert changes(spark, "v1", t) == [
        ("INSERT", "depot.shelves", "4/AB", 0, "{}", full), ("UPDATE", "depot.shelves", "4/AB", 1, '{"code":"B-7"}', full), ("DELETE", "depot.shelves", "4/AB", 3, '{"code":"B-7"}', "{}"),
    ]
    assert changes(spark, "V1", transaction(v1("insert", **NEW), lsn=None), stream="9/9")[0][2] == "9/9"
    assert changes(spark, "V1", transaction()) == []


@pytest.mark.parametrize("types, values, want", [(["varchar"], ["p", 1], '{"x":"p","y":1}'), (["varchar", "int"], ["p"], "{}"), (["varchar", "int"], ["p", None], '{"x":"p","y":null}')])
def test_v1_lists_of_unequal_length(spark, types, values, want):
    """Without as many values as names there are no columns; types may be missing."""
    t = transaction(v1("insert", columnnames=["x", "y"], columntypes=types, columnvalues=values))
    assert changes(spark, "V1", t)[0][5] == want
    kinds = wal2json.decode_v1(raw(spark, t)).select(F.get("columns", 0)["type"]).first()[0]
    assert kinds == ("varchar" if len(types) == 2 and len(values) == 2 else None)


def test_v1_messages_and_unreadable_texts(spark):
    whole, half = {"kind": "message", "transactional": False, "prefix": "depot", "content": "moved"}, {"kind": "message", "prefix": "depot", "content": "moved"}
    d = wal2json.decode_v1(raw(spark, transaction(whole, half), {"change": []}, "{"))
    assert [(r.seq, r.kind, r.content, r.transactional, r.error) for r in d.collect()] == [
        (0, "message", "moved", False, None), (1, "message", None, None, "message without prefix, content or transactional"), (0, None, None, None, "unreadable"), (0, None, None, None, "unreadable"),
    ]


def test_v1_all_messages_of_a_transaction_become_events(spark):
    said = [{"kind": "message", "transactional": True, "prefix": p, "content": "-"} for p in ("sns://depot", "SQS|moves|fifo", "plain", "://none")]
    e = mapping.events_from_messages(wal2json.messages(wal2json.decode_v1(raw(spark, transaction(*said))))).select("id", "scheme", "target").collect()
    assert [tuple(x) for x in e] == [("4/AB", "sns", "depot"), ("4/AB", "sqs", "moves|fifo"), ("4/AB", "sns", "plain"), ("4/AB", None, None)]


def test_unknown_format():
    with pytest.raises(ValueError):
        wal2json.decode(None, "V3")


def test_each_text_is_parsed_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for version in ("V1", "V2"):
        records = wal2json.decode(raw(spark, shelf("I")), version)
        for df in (wal2json.row_changes(records), wal2json.messages(records), wal2json.dropped(records)):
            assert plan(df).count("from_json(") == 1
    queue = spark.createDataFrame([(1, "{}", False)], "receipt long, body string, in_flight boolean")
    assert plan(deadletters.rebuild(deadletters.parsed(queue), F.current_timestamp())).count("from_json(") == 1
