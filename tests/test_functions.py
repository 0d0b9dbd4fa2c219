import random

import pytest
from pyspark.sql import functions as F

from sluiceway.checkpoints import file_name
from sluiceway.functions import positions, routing
from sluiceway.functions.backoff import PUBLISH, BackOff


def values(spark, given, make):
    return [r[0] for r in spark.createDataFrame([(g,) for g in given], "x string").coalesce(1).select(make(F.col("x"))).collect()]


def pairs(spark, given, make):
    return [None if r is None else tuple(r) for r in values(spark, given, make)]


def test_routing(spark):
    assert pairs(spark, ["Kafka://orders.events", "orders.events", "://orders.events", "a://b://c", None], routing.parse_uri) == [("kafka", "orders.events"), None, None, ("a", "b://c"), None]
    assert pairs(spark, ["sns://orders.events", "kafka://orders/cluster-a", "SNS|orders.events", "SQS|orders-queue|x", "orders.events", "", None], routing.parse_prefix) == [
        ("sns", "orders.events"), ("kafka", "orders/cluster-a"), ("sns", "orders.events"), ("sqs", "orders-queue|x"), ("sns", "orders.events"), ("sns", ""), None,
    ]
    assert pairs(spark, ["topic", "SNS|t", "SQS|q", "sns|t", "SNS|a|b", "sns://x"], routing.parse_legacy_prefix) == [("sns", "topic"), ("sns", "t"), ("sqs", "q"), None, None, ("sns", "sns://x")]
    ok = [("sns", "t", True), ("SNS", "t", False), (" ", "t", False), ("sns", "", False), (None, "t", False), ("amqp", "exchange/routingKey", True)]
    d = spark.createDataFrame([(a, b) for a, b, _ in ok], "s string, t string").coalesce(1)
    assert [r[0] for r in d.select(routing.valid(d.s, d.t)).collect()] == [x for *_, x in ok]
    assert d.select(routing.as_uri(d.s, d.t)).collect()[-1][0] == "amqp://exchange/routingKey"


def test_lsn(spark):
    given = ["0/16E8198", "FFFFFFFF/FFFFFFFF", "0/0", "1/0", "junk", "1/G", "", None, "0/123456789"]
    assert values(spark, given, lambda c: positions.lsn_order(c).cast("string")) == ["24019352", str(2**64 - 1), "0", str(2**32), None, None, None, None, None]
    assert values(spark, given, lambda c: positions.lsn_resolve(c, F.lit("s")))[:4] == ["0/16E8198", "FFFFFFFF/FFFFFFFF", "s", "1/0"]


def test_binlog_positions(spark):
    given = ["mysql-bin.000007:4321", "a:b:5", "garbage", ":5", "f:", "f:x", "f:99999999999999999999", None]
    assert pairs(spark, given, positions.binlog_position) == [("mysql-bin.000007", 4321), ("a:b", 5), None, None, None, None, None, None]


def test_checkpoint_names(spark):
    keys = ["binlog:65536", "pg-wal:orders_slot", "a/b c", "é1.٣"]
    names = values(spark, keys, positions.checkpoint_file_name)
    assert names == ["binlog_65536", "pg-wal_orders_slot", "a_b_c", "é1.٣"] and [file_name(k) for k in keys] == [n + ".json" for n in names]


def test_back_off(spark):
    b = BackOff(100, 1000, 2.0, 0.0)
    assert [b.delay_ms(n) for n in (-1, 0, 1, 2, 3, 4, 5, 10_000)] == [100, 100, 100, 200, 400, 800, 1000, 1000]
    j = BackOff(100, 1000, 2.0, 0.5)
    assert all(500 <= j.delay_ms(9, random.Random(i)) <= 1500 for i in range(200))
    d = spark.range(100)
    assert all(500 <= r[0] <= 1500 for r in d.select(j.column(F.lit(9), 3)).collect())
    assert [r[0] for r in spark.range(1, 4).select(PUBLISH.column(F.col("id"))).collect()] == [100, 200, 400]
    for bad in ((0, 1, 2, 0), (5, 1, 2, 0), (1, 5, 0.5, 0), (1, 5, 2, 1.5)):
        with pytest.raises(ValueError):
            BackOff(*bad)
