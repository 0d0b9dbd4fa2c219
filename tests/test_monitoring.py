import datetime
import math

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import monitoring as M

T0 = datetime.datetime(2026, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def samples(spark, *rows):
    return spark.createDataFrame([(at(t), n, tags, float(v)) for t, n, tags, v in rows], "ts timestamp, name string, tags map<string,string>, value double")


def test_lag(spark):
    d = spark.createDataFrame([("0/16E8198", "0/16E8100"), ("0/1", None), (None, "0/1"), ("1/0", "0/FFFFFFFF")], "head_lsn string, confirmed_lsn string").coalesce(1)
    assert [r.lag_bytes for r in M.postgres_lag(d).collect()] == [152, None, None, 1]
    rows = [("b.1", 100, "b.1:40"), ("b.1", 100, None), ("b.1", 100, "junk"), ("b.2", 100, "b.1:40"), ("b.1", 10, "b.1:40"), (None, None, "b.1:40")]
    d = spark.createDataFrame(rows, "server_file string, server_pos long, checkpoint string").coalesce(1)
    assert [r.lag_bytes for r in M.binlog_lag(d).collect()] == [60, None, None, None, None, None]


def test_rotation_is_told_once_and_again_after_a_match(spark):
    files = ["1", "2", "2", "1", "2"]
    d = spark.createDataFrame([(i, "s", f, 1, "1:0") for i, f in enumerate(files)], "i int, s string, server_file string, server_pos long, checkpoint string")
    assert [r.log for r in M.rotation_log(d, ["s"], "i").orderBy("i").collect()] == [False, True, False, False, True]


def test_sampler_keeps_the_last_value(spark):
    d = spark.createDataFrame([(0, "s", None), (1, "s", 5), (2, "s", None), (3, "s", 7)], "i int, s string, lag long")
    got = [r.gauge for r in M.sampled(d, ["s"], "i").orderBy("i").collect()]
    assert math.isnan(got[0]) and got[1:] == [5, 5, 7]


def test_health(spark):
    cases = [(True, True, None, 5, "UP", "UP"), (True, True, "0/1", 5, "DOWN", "DOWN"), (True, False, None, 5, "DOWN", "UP"), (False, True, None, 5, "DOWN", "DOWN"), (True, True, None, 61, "OUT_OF_SERVICE", "OUT_OF_SERVICE"), (True, True, None, -1, "UP", "UP")]
    d = spark.createDataFrame([c[:4] + (60,) for c in cases], "running boolean, lifecycle_running boolean, pending string, ms_idle long, max_idle_ms long").coalesce(1)
    assert [r.status for r in M.health(d).collect()] == [c[4] for c in cases]
    assert [r.status for r in M.legacy_health(d).collect()] == [c[5] for c in cases]


def test_rates_and_totals(spark):
    s = samples(spark, (0, "c", {"k": "a"}, 3), (10, "c", {"k": "a"}, 3), (310, "c", {}, 30), (10, "x", {"k": "z"}, 1))
    assert sorted(map(tuple, M.rate(s, "c", ["k"]).collect())) == [(T0, "a", 6 / 300), (at(300), "", 30 / 300)]
    assert M.latest(s, "c", ["k"]).orderBy("k").first().value == 30 and {r.k: r.total for r in M.total(s, "c", ["k"]).collect()} == {"a": 6, "": 30}
    assert [tuple(r) for r in M.running_total(s, "c").orderBy("start").collect()] == [(T0, 6), (at(300), 36)]
    assert sorted(r.k for r in M.tag_values(s, "k").collect()) == ["a", "z"]
    q = M.quantiles(s, "c", [], {"p50": 0.5, "p95": 0.95}).first()
    assert (q.p50, q.p95) == (3, pytest.approx(27.3))
    assert M.quantiles(s, "c", [], {"p50": 0.5}, exact=False).first().p50 == 3
    assert M.rate(s.limit(0), "c", []).count() == 0 and M.dense_rate(s.limit(0), "c", 300).count() == 0


def test_held_for(spark):
    on = [0, 1, 2, 5, 6, 9]
    d = spark.createDataFrame([("g", at(60 * i), i in on) for i in range(12)], "g string, start timestamp, on boolean")
    got = sorted((r.since, r.until, r.seconds) for r in M.held_for(d, ["g"], 120, 60).collect())
    assert got == [(at(0), at(120), 180), (at(300), at(360), 120)]
    gap = spark.createDataFrame([("g", at(0), True), ("g", at(120), True)], "g string, start timestamp, on boolean")
    assert M.held_for(gap, ["g"], 120, 60).count() == 0


def test_nothing_read_counts_empty_windows(spark):
    s = samples(spark, (0, "c", {}, 1), (3000, "c", {}, 1))
    r = M.dense_rate(s, "c", 600).withColumn("on", F.col("rate") == 0)
    assert [(x.since, x.seconds) for x in M.held_for(r, [], 1800, 600).collect()] == [(at(600), 2400)]
    assert M.alert(s, "c", [], 0, 300).count() == 2


def test_sliding_increase(spark):
    s = samples(spark, (0, "c", {}, 4), (1800, "c", {}, 3))
    assert max(r.increase for r in M.increase(s, "c").collect()) == 7
