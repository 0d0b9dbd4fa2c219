"""Lag, health and the operational queries over metric samples.

Samples are rows (ts, name, tags map, value); increments for counters, observed values for timers and gauges.  A rate is
the sum of increments in a window over its seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import positions

HIGH_LAG = 100_000_000


def postgres_lag(slots: DataFrame) -> DataFrame:
    """slots (slot, head_lsn, confirmed_lsn) with lag_bytes; null if either position is missing."""
    return slots.withColumn("lag_bytes", (positions.lsn_order(F.col("head_lsn")) - positions.lsn_order(F.col("confirmed_lsn"))).cast("long"))


def binlog_lag(rows: DataFrame) -> DataFrame:
    """rows (server_file, server_pos, checkpoint) with lag_bytes: the distance inside one file; null after a rotation, for
    a missing or malformed checkpoint, and if it would be negative."""
    p = positions.binlog_position(F.col("checkpoint"))
    diff = F.col("server_pos") - p["pos"]
    return rows.withColumn("lag_bytes", F.when((p["file"] == F.col("server_file")) & (diff >= 0), diff))


def rotation_log(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with log: the checkpoint's file differs from the server's, and it did not at the sample before."""
    p = positions.binlog_position(F.col("checkpoint"))
    w = Window.partitionBy(*by).orderBy(order)
    differs = F.coalesce(p["file"] != F.col("server_file"), F.lit(False))
    return rows.withColumn("_d", differs).withColumn("log", F.col("_d") & ~F.coalesce(F.lag("_d").over(w), F.lit(False))).drop("_d")


def sampled(samples: DataFrame, by: list[str], order: str, value: str = "lag") -> DataFrame:
    """samples with gauge: the last known value so far, NaN before the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return samples.withColumn("gauge", F.coalesce(F.last(F.col(value).cast("double"), ignorenulls=True).over(w), F.lit(float("nan"))))


def health(states: DataFrame) -> DataFrame:
    """states (running, lifecycle_running, pending, ms_idle, max_idle_ms) with status; a negative ms_idle: never active."""
    idle = (F.col("ms_idle") >= 0) & (F.col("ms_idle") > F.col("max_idle_ms"))
    return states.withColumn("status", F.when(F.col("pending").isNotNull(), "DOWN").when(~F.col("lifecycle_running"), "DOWN").when(~F.col("running"), "DOWN").when(idle, "OUT_OF_SERVICE").otherwise("UP"))


def legacy_health(states: DataFrame) -> DataFrame:
    """The older rule: only running, pending and idleness count."""
    return states.withColumn("status", F.when(F.col("pending").isNotNull(), "DOWN").when(~F.col("running"), "DOWN").when(F.col("ms_idle") > F.col("max_idle_ms"), "OUT_OF_SERVICE").otherwise("UP"))


def _tag(name: str) -> Column:
    return F.coalesce(F.col("tags")[name], F.lit("")).alias(name)


def rate(samples: DataFrame, name: str, tags: list[str], seconds: int = 300) -> DataFrame:
    """Increments a second of one counter by window and tags."""
    w = F.window("ts", f"{seconds} seconds")
    return (
        samples.filter(F.col("name") == name).groupBy(w.alias("w"), *[_tag(t) for t in tags])
        .agg((F.sum("value") / F.lit(float(seconds))).alias("rate")).select(F.col("w.start").alias("start"), *tags, "rate")
    )


def quantiles(samples: DataFrame, name: str, tags: list[str], at: dict[str, float], exact: bool = True) -> DataFrame:
    """Percentiles of one timer by tags.  Exact ones count equal values first, so a group's state is its different values;
    approximate ones keep bounded state by group."""
    s = samples.filter(F.col("name") == name).select(*[_tag(t) for t in tags], "value")
    if not exact:
        return s.groupBy(*tags).agg(*[F.percentile_approx("value", p, 10_000).alias(n) for n, p in at.items()])
    counts = s.groupBy(*tags, "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*tags).agg(*[F.percentile("value", F.lit(p), F.col("n")).alias(n) for n, p in at.items()])


def latest(samples: DataFrame, name: str, tags: list[str]) -> DataFrame:
    """The latest value of one gauge by tags."""
    return samples.filter(F.col("name") == name).groupBy(*[_tag(t) for t in tags]).agg(F.max_by("value", "ts").alias("value"))


def total(samples: DataFrame, name: str, tags: list[str]) -> DataFrame:
    """The sum of one counter by tags."""
    return samples.filter(F.col("name") == name).groupBy(*[_tag(t) for t in tags]).agg(F.sum("value").alias("total"))


def running_total(samples: DataFrame, name: str, seconds: int = 300) -> DataFrame:
    """The sum of one counter up to the end of each window.  Windows are summed first, so what is ordered is one row by
    window, not by sample."""
    sums = samples.filter(F.col("name") == name).groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.sum("value").alias("v"))
    whole = Window.partitionBy(F.lit(0)).orderBy("w.start").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select(F.col("w.start").alias("start"), F.sum("v").over(whole).alias("total"))


def tag_values(samples: DataFrame, tag: str) -> DataFrame:
    """The values that a tag has."""
    return samples.select(F.col("tags")[tag].alias(tag)).dropna().distinct()


def spine(samples: DataFrame, seconds: int) -> DataFrame:
    """All windows from the first sample to the last, also those without samples."""
    span = samples.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).dropna()
    floor = lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(c) / seconds) * seconds)
    return span.select(F.explode(F.sequence(floor("a"), floor("b"), F.expr(f"interval {seconds} seconds"))).alias("start"))


def dense_rate(samples: DataFrame, name: str, seconds: int) -> DataFrame:
    """The rate of one counter in every window, 0 where it has no samples."""
    per = rate(samples, name, [], seconds)
    return spine(samples, seconds).join(per, "start", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def held_for(states: DataFrame, by: list[str], seconds: int, step: int, start: str = "start", condition: str = "on") -> DataFrame:
    """Stretches in which a condition holds at each step, at least so many seconds long: by, since, until, seconds.

    states has a row by group and step, condition a boolean.  A step that is missing ends a stretch."""
    w = Window.partitionBy(*by).orderBy(start) if by else Window.partitionBy(F.lit(0)).orderBy(start)
    on = states.filter(F.col(condition))
    new = F.coalesce(F.unix_timestamp(start) - F.unix_timestamp(F.lag(start).over(w)) > step, F.lit(True))
    runs = on.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "_run").agg(F.min(start).alias("since"), F.max(start).alias("until"))
    length = F.unix_timestamp("until") - F.unix_timestamp("since") + step
    return out.withColumn("seconds", length).filter(F.col("seconds") >= seconds).drop("_run")


def alert(samples: DataFrame, name: str, tags: list[str], above: float, hold: int, seconds: int = 300, where: Column | None = None) -> DataFrame:
    """When the rate of a counter stayed above a bound for so long, by tags."""
    s = samples if where is None else samples.filter(where)
    r = rate(s, name, tags, seconds).withColumn("on", F.col("rate") > above)
    return held_for(r, tags, hold, seconds)


def increase(samples: DataFrame, name: str, window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """How much a counter grew in each sliding window."""
    w = F.window("ts", window, slide)
    return samples.filter(F.col("name") == name).groupBy(w.alias("w")).agg(F.sum("value").alias("increase")).select(F.col("w.end").alias("end"), "increase")
