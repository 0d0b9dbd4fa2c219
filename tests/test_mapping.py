import datetime

import pytest
from pyspark.sql import functions as F

from sluiceway.model import Key, Payload, Routing, TableMapping, mappings_from_config
from sluiceway.operators import mapping

AT = datetime.datetime(2026, 5, 15)
T = "public.orders"


def rule(sink="sns://orders-events", attributes=None, **more):
    return TableMapping(table=more.pop("table", T), key=more.pop("key", Key(("id",))), routing=Routing(sink, attributes or {}), **more)


def change(spark, op="INSERT", after='{"id":42,"status":"PENDING","total_cents":999}', before="{}", table=T, checkpoint="0/16E8198"):
    d = spark.createDataFrame([(op, table, checkpoint, AT, before, after)], "op string, table string, source_checkpoint string, occurred_at timestamp, b string, a string")
    return d.select("op", "table", "source_checkpoint", "occurred_at", F.from_json("b", "map<string,variant>").alias("before"), F.from_json("a", "map<string,variant>").alias("after"))


def events(spark, r, serializer="lines", **c):
    rules = r if isinstance(r, tuple) else (r,)
    return mapping.apply(change(spark, **c), rules, serializer).withColumn("payload", F.decode("payload", "UTF-8")).collect()


def test_dropped(spark):
    assert events(spark, rule(), table="public.customers") == []
    assert events(spark, rule(capture=frozenset({"INSERT"})), op="UPDATE") == []
    assert events(spark, rule(), table="PUBLIC.orders") == []
    assert events(spark, ()) == []


def test_full_event(spark):
    (e,) = events(spark, rule(key=Key(("id",), "order:{id}"), payload=Payload(include=("status", "id", "nothing"))))
    assert (e.id, e.scheme, e.target, e.payload, e.source_checkpoint, e.occurred_at, e.headers) == ("order:42", "sns", "orders-events", "id=42\nstatus=PENDING", "0/16E8198", AT, {"eventType": "public.orders.created"})


def test_delete_uses_before(spark):
    (e,) = events(spark, rule(), op="DELETE", before='{"id":7}', after="{}")
    assert (e.id, e.event_type, e.payload) == ("7", "public.orders.deleted", "id=7")


@pytest.mark.parametrize("op, name", [("INSERT", "created"), ("UPDATE", "updated"), ("DELETE", "deleted")])
def test_event_type(spark, op, name):
    (e,) = events(spark, rule(event_type="orders.{op}.{x}"), op=op)
    assert e.event_type == f"orders.{name}.{{x}}"


def test_payloads(spark):
    row = '{"id":1,"name":"Ada","password_hash":"x","total_cents":5,"created_at":null}'
    assert events(spark, rule(payload=Payload(exclude=("password_hash", "total_cents", "created_at"))), after=row)[0].payload == "id=1\nname=Ada"
    renamed = rule(payload=Payload(exclude=("password_hash",), rename={"total_cents": "totalCents", "created_at": "createdAt"}))
    assert events(spark, renamed, "json", after=row)[0].payload == '{"id":1,"name":"Ada","totalCents":5,"createdAt":null}'
    collide = rule(payload=Payload(include=("id", "name", "total_cents"), rename={"total_cents": "id"}))
    assert events(spark, collide, "json", after=row)[0].payload == '{"id":5,"name":"Ada"}'
    assert events(spark, rule(), "json", after='{"o":{"b":1},"l":[1,null],"t":true,"f":1.5}')[0].payload == '{"o":{"b":1},"l":[1,null],"t":true,"f":1.5}'


def test_keys_and_attributes(spark):
    row = '{"id":42,"tenant_id":"acme","n":null}'
    e = events(spark, rule(key=Key(("tenant_id", "n", "id")), attributes={"tenant": "{tenant_id}", "constant": "fixed", "odd": "{1}{n}{missing}{}"}), after=row)[0]
    assert e.id == "acme||42" and e.attributes == {"tenant": "acme", "constant": "fixed", "odd": "{1}{}"}
    assert events(spark, rule(key=Key((), "ignored:{id}")), checkpoint="0/CAFE")[0].id == "0/CAFE"


def test_rules_are_checked():
    with pytest.raises(ValueError):
        Payload(include=("a",), exclude=("b",))
    with pytest.raises(ValueError):
        Routing("orders.events")
    with pytest.raises(ValueError):
        Routing("://x")
    with pytest.raises(ValueError, match="public.orders"):
        mapping.checked((rule(), rule()))
    with pytest.raises(ValueError):
        rule(capture=frozenset({"TRUNCATE"}))
    (r,) = mappings_from_config([{"table": "t", "capture": ["insert"], "key": {"columns": ["id"], "format": "{id}"}, "payload": {"exclude": ["x"]}, "routing": {"sink": "kafka://k", "attributes": {"a": "{b}"}}}])
    assert r == TableMapping("t", Routing("kafka://k", {"a": "{b}"}), frozenset({"INSERT"}), Key(("id",), "{id}"), Payload(exclude=("x",)))


def test_two_rules_and_other_columns_pass_through(spark):
    d = change(spark).unionByName(change(spark, table="t2")).withColumn("extra", F.lit(1))
    got = mapping.apply(d, (rule(), rule("Kafka://k/x", table="t2"))).select("scheme", "target", "extra").collect()
    assert sorted(map(tuple, got)) == [("kafka", "k/x", 1), ("sns", "orders-events", 1)]
    assert {(r.table, r.reason): r.n for r in mapping.skipped(d, (rule(capture=frozenset({"DELETE"})),)).collect()} == {(T, "operation not captured"): 1, ("t2", "no mapping"): 1}


def test_mapping_is_one_narrow_pass(spark):
    plan = mapping.apply(change(spark), (rule(), rule(table="t2")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
