"""Queries of lag, health, dashboards and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import monitoring as M
from .catalogue import query
from .fixtures import OUTBOX, SAMPLES, in_duckdb, in_spark

D, D_OUTBOX = in_duckdb(SAMPLES), in_duckdb(OUTBOX)
TAGS = ("slot", "sink", "topic", "cause", "attempt", "outcome")


def samples(spark, sf_dir) -> DataFrame:
    tags = F.create_map(*[x for t in TAGS for x in (F.lit(t), F.col(t))], F.lit("table"), F.col("tab"))
    s = in_spark(spark, sf_dir, SAMPLES)
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "name", tags.alias("tags"), F.round("value").alias("value"))


S = f"(select event_id, ts, name, slot, sink, topic, cause, attempt, outcome, tab as \"table\", round(value) as value from ({D}))"


def _rate_sql(name: str, tags: list[str], seconds: int = 300) -> str:
    cols = "".join(f', "{t}"' for t in tags)
    return f"select time_bucket(interval {seconds} second, ts, timestamp '1970-01-01') as start{cols}, sum(value) / {seconds}.0::double as rate from {S} where name = '{name}' group by all"


def _rate(name: str, tags: list[str]):
    def f(spark, sf_dir):
        return M.rate(samples(spark, sf_dir), name, tags).withColumn("start", F.col("start").cast("timestamp_ntz"))

    return f


for _name, _series, _tags in (
    ("a01_read_rate", "messages_read", ["slot"]),
    ("a02_published_rate", "published", ["sink", "topic"]),
    ("a03_failed_rate", "failed", ["sink", "cause"]),
    ("a06_retry_rate", "failed", ["sink", "attempt"]),
    ("a07_dead_letter_rate", "dead_lettered", ["cause"]),
    ("a08_dlq_failure_rate", "failed", ["cause"]),
    ("a09_dlq_replay_rate", "dlq_replays", ["outcome"]),
    ("a10_parse_error_rate", "failed", ["cause", "slot"]),
    ("a11_fallback_rate", "messages_read", ["table"]),
    ("a12_drift_rate", "dead_lettered", ["table"]),
    ("a14_replay_event_rate", "dlq_replays", ["slot", "outcome"]),
):
    _f = _rate(_series, _tags)
    _f.__name__ = _name
    _f.__doc__ = f"Rate of {_series} by {', '.join(_tags)} in five-minute windows."
    query(_rate_sql(_series, _tags))(_f)


def _rounded(df: DataFrame) -> DataFrame:
    """Interpolated values may differ in their last digit between engines."""
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("p") else c for c in df.columns])


@query(f"select sink, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from {S} where name = 'published' group by sink")
def a04_latency(spark, sf_dir):
    """Exact latency percentiles by sink (A4)."""
    return _rounded(M.quantiles(samples(spark, sf_dir), "published", ["sink"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


@query(f"select slot, round(quantile_cont(value, 0.95), 6) as p95 from {S} where name = 'dlq_replays' group by slot")
def a15_replay_duration(spark, sf_dir):
    """Replay duration percentile by kind."""
    return _rounded(M.quantiles(samples(spark, sf_dir), "dlq_replays", ["slot"], {"p95": 0.95}))


@query(f"select slot, max_by(value, ts) as value from {S} where name = 'messages_read' group by slot")
def a05_gauge(spark, sf_dir):
    """The latest sample of a gauge (A5)."""
    return M.latest(samples(spark, sf_dir), "messages_read", ["slot"])


@query(f"select start, sum(v) over (order by start) as total from (select time_bucket(interval 300 second, ts, timestamp '1970-01-01') as start, sum(value) as v from {S} where name = 'dead_lettered' group by 1)")
def a07_dead_letter_total(spark, sf_dir):
    """The cumulative total over time."""
    return M.running_total(samples(spark, sf_dir), "dead_lettered").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"select outcome, sum(value) as total from {S} where name = 'dlq_replays' group by outcome")
def a13_orphans(spark, sf_dir):
    """Totals by outcome."""
    return M.total(samples(spark, sf_dir), "dlq_replays", ["outcome"])


@query(f"select slot as v, 'slot' as tag from {S} group by slot union all select sink, 'sink' from {S} group by sink")
def a16_tag_values(spark, sf_dir):
    """The values that slot and sink have."""
    s = samples(spark, sf_dir)
    return M.tag_values(s, "slot").select(F.col("slot").alias("v"), F.lit("slot").alias("tag")).union(M.tag_values(s, "sink").select("sink", F.lit("sink")))


def _held_sql(states: str, by: list[str], hold: int, step: int) -> str:
    """Islands of a condition: states has by, start and on_."""
    cols = ", ".join(f'"{b}"' for b in by)
    part, lead = (f"partition by {cols} " if by else ""), (cols + ", " if by else "")
    return f"""
with s as ({states}), o as (select {lead}start, case when date_diff('second', lag(start) over ({part}order by start), start) <= {step} then 0 else 1 end as new from s where on_),
r as (select *, sum(new) over ({part}order by start) as run from o),
g as (select {lead}min(start) as since, max(start) as until from r group by {lead}run)
select {lead}since, until, date_diff('second', since, until) + {step} as seconds from g where date_diff('second', since, until) + {step} >= {hold}"""


def _alert_sql(name: str, tags: list[str], above: float, hold: int, seconds: int, where: str = "true") -> str:
    cols = "".join(f', "{t}"' for t in tags)
    r = f"select time_bucket(interval {seconds} second, ts, timestamp '1970-01-01') as start{cols}, sum(value) / {seconds}.0::double > {above} as on_ from {S} where name = '{name}' and {where} group by all"
    r = r.replace("group by all", "group by 1" + "".join(f", {i + 2}" for i in range(len(tags))))
    return _held_sql(r, tags, hold, seconds)


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})


@query(_alert_sql("failed", ["cause"], 0, 300, 300))
def a17_dlq_failing(spark, sf_dir):
    """Failures of the dead-letter sink for five minutes."""
    return _plain(M.alert(samples(spark, sf_dir), "failed", ["cause"], 0, 300))


@query(_held_sql(f"select slot, time_bucket(interval 3600 second, ts, timestamp '1970-01-01') as start, max(value) < 40 as on_ from {S} group by 1, 2", ["slot"], 7200, 3600))
def a18_down(spark, sf_dir):
    """A condition on gauges held for two steps (A18; here: no sample of 40 or more in the hour)."""
    s = samples(spark, sf_dir).groupBy(F.col("tags.slot").alias("slot"), F.window("ts", "3600 seconds").alias("w")).agg((F.max("value") < 40).alias("on"))
    return _plain(M.held_for(s.select("slot", F.col("w.start").alias("start"), "on"), ["slot"], 7200, 3600))


@query(_held_sql(f"select time_bucket(interval 600 second, ts, timestamp '1970-01-01') as start, max(value) * 1000000 > 100000000 as on_ from {S} where name = 'messages_read' group by 1", [], 600, 600))
def a19_high_lag(spark, sf_dir):
    """Lag over a bound for ten minutes."""
    s = samples(spark, sf_dir).filter("name = 'messages_read'").groupBy(F.window("ts", "600 seconds").alias("w")).agg((F.max("value") * 1_000_000 > M.HIGH_LAG).alias("on"))
    return _plain(M.held_for(s.select(F.col("w.start").alias("start"), "on"), [], 600, 600))


_SPINE = f"(select unnest(generate_series(time_bucket(interval 600 second, min(ts), timestamp '1970-01-01'), time_bucket(interval 600 second, max(ts), timestamp '1970-01-01'), interval 600 second)) as start from {S})"


@query(_held_sql(f"select start, coalesce(rate, 0) = 0 as on_ from {_SPINE} left join ({_rate_sql('messages_read', [], 600)}) using (start)", [], 1800, 600))
def a20_nothing_read(spark, sf_dir):
    """Nothing read for half an hour, also in windows without samples."""
    r = M.dense_rate(samples(spark, sf_dir), "messages_read", 600).withColumn("on", F.col("rate") == 0)
    return _plain(M.held_for(r, [], 1800, 600))


@query(_alert_sql("dead_lettered", ["table"], 0, 0, 300))
def a21_drift(spark, sf_dir):
    """Any schema drift, at once."""
    return _plain(M.alert(samples(spark, sf_dir), "dead_lettered", ["table"], 0, 0))


@query(_alert_sql("dlq_replays", [], 0.1, 300, 300, "outcome = 'publish_failed'"))
def a22_replay_failing(spark, sf_dir):
    """Failing replays above a rate."""
    return _plain(M.alert(samples(spark, sf_dir), "dlq_replays", [], 0.1, 300, where=F.col("tags.outcome") == "publish_failed"))


@query(_alert_sql("dead_lettered", [], 0.1, 300, 300))
def a23_dead_letters_rising(spark, sf_dir):
    """Dead letters above a rate for five minutes."""
    return _plain(M.alert(samples(spark, sf_dir), "dead_lettered", [], 0.1, 300))


@query(f"""
with w as (select w."end" + o * interval 5 minute as "end", value from (select time_bucket(interval 300 second, ts, timestamp '1970-01-01') + interval 5 minute as "end", value from {S} where name = 'failed') w, generate_series(0, 11) g(o))
select "end", sum(value) as increase, sum(value) > 100 as firing from w group by 1""")
def a24_orphans_growing(spark, sf_dir):
    """Growth in a sliding hour."""
    i = M.increase(samples(spark, sf_dir), "failed")
    return i.select(F.col("end").cast("timestamp_ntz").alias("end"), "increase", (F.col("increase") > 100).alias("firing"))


_SLOTS = f"(select id, concat('0/', upper(to_hex(id * 100 + 1000))) as head, case when id % 5 = 0 then null when id % 5 = 1 then 'bad' else concat('0/', upper(to_hex(id * 99 + 1))) end as confirmed from ({D_OUTBOX}))"


@query(f"select id, case when id % 5 > 1 then id + 999 else -1 end as lag_bytes from {_SLOTS}")
def l02_postgres_lag(spark, sf_dir):
    """Bytes between the head and a slot; -1 stands for unknown."""
    d, x = in_spark(spark, sf_dir, OUTBOX), F.col("id")
    lsn = lambda c: F.concat(F.lit("0/"), F.hex(c))
    d = d.select("id", lsn(x * 100 + 1000).alias("head_lsn"), F.when(x % 5 == 0, None).when(x % 5 == 1, "bad").otherwise(lsn(x * 99 + 1)).alias("confirmed_lsn"))
    return M.postgres_lag(d).select("id", F.coalesce("lag_bytes", F.lit(-1)).alias("lag_bytes"))


def _server(spark, sf_dir) -> DataFrame:
    """Samples of server position and checkpoint: a new file each 50 samples, checkpoints 7 behind, some bad."""
    x = F.col("id")
    file = lambda c: F.concat(F.lit("bin."), F.floor(c / 50).cast("string"))
    behind = x - 7
    check = F.when(x % 11 == 0, None).when(x % 11 == 1, "bad").otherwise(F.concat(file(behind), F.lit(":"), (behind * 10 + F.when(x % 13 == 0, 1000).otherwise(0)).cast("string")))
    return in_spark(spark, sf_dir, OUTBOX).select("id", (x % 2).alias("source"), file(x).alias("server_file"), (x * 10).alias("server_pos"), check.alias("checkpoint"))


_LAG = f"(select id, id % 2 as source, floor(id / 50.0) as f, floor((id - 7) / 50.0) as g, id % 11 < 2 as bad, 70 - case when id % 13 = 0 then 1000 else 0 end as diff from ({D_OUTBOX}))"


@query(f"select id, case when not bad and f = g and diff >= 0 then diff else -1 end::bigint as lag_bytes from {_LAG}")
def l03_binlog_lag(spark, sf_dir):
    """Bytes inside one log file; -1 stands for unknown (L3)."""
    return M.binlog_lag(_server(spark, sf_dir)).select("id", F.coalesce("lag_bytes", F.lit(-1)).alias("lag_bytes"))


@query(f"with d as (select *, not bad and id >= 7 and f <> g as differs from {_LAG}) select id, differs and not coalesce(lag(differs) over (partition by source order by id), false) as log from d")
def l05_rotation_log(spark, sf_dir):
    """One message by rotation."""
    return M.rotation_log(_server(spark, sf_dir).withColumn("checkpoint", F.when(F.col("id") >= 7, F.col("checkpoint"))), ["source"], "id").select("id", "log")


@query(f"with l as (select id, source, case when not bad and id >= 7 and f = g and diff >= 0 then diff end as lag from {_LAG}), g as (select *, last_value(lag ignore nulls) over (partition by source order by id) as v from l) select id, coalesce(v, -1)::double as gauge from g")
def l04_sampled_gauge(spark, sf_dir):
    """The last known lag at each sample (L4; -1 stands for none so far)."""
    s = M.binlog_lag(_server(spark, sf_dir).withColumn("checkpoint", F.when(F.col("id") >= 7, F.col("checkpoint"))))
    return M.sampled(s, ["source"], "id", "lag_bytes").select("id", F.when(F.isnan("gauge"), -1.0).otherwise(F.col("gauge")).alias("gauge"))


_STATES = f"(select id, id % 3 > 0 as running, id % 5 > 0 as life, id % 7 = 0 as pending, case when id % 11 = 0 then -1 else id % 100 end as idle from ({D_OUTBOX}))"


def _states(spark, sf_dir) -> DataFrame:
    x = F.col("id")
    return in_spark(spark, sf_dir, OUTBOX).select("id", (x % 3 > 0).alias("running"), (x % 5 > 0).alias("lifecycle_running"), F.when(x % 7 == 0, "0/1").alias("pending"), F.when(x % 11 == 0, -1).otherwise(x % 100).alias("ms_idle"), F.lit(60).alias("max_idle_ms"))


@query(f"select id, case when pending or not life or not running then 'DOWN' when idle >= 0 and idle > 60 then 'OUT_OF_SERVICE' else 'UP' end as status from {_STATES}")
def l06_health(spark, sf_dir):
    return M.health(_states(spark, sf_dir)).select("id", "status")


@query(f"select id, case when pending or not running then 'DOWN' when idle > 60 then 'OUT_OF_SERVICE' else 'UP' end as status from {_STATES}")
def l07_legacy_health(spark, sf_dir):
    return M.legacy_health(_states(spark, sf_dir)).select("id", "status")
