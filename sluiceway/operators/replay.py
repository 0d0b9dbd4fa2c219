"""Bounded replay of a log between two positions."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing

MAX_EVENTS, MAX_SECONDS = 100_000, 600


class UnsupportedReplay(ValueError):
    pass


def position(text: str) -> tuple[str, int]:
    """(file, position) of file:position, split at the last colon."""
    m = re.fullmatch(r"(.+):([0-9]+)", text or "", re.S)
    if not m:
        raise UnsupportedReplay(f"not a binlog position: {text!r}")
    return m[1], int(m[2])


def window(log: DataFrame, start: str, end: str) -> DataFrame:
    """Rows (file, pos: the end of each) from start, without those at the end or after it.  Files compare as text.  The
    conditions are on plain columns, so that a Parquet scan gets them."""
    (f1, p1), (f2, p2) = position(start), position(end)
    after = (F.col("file") > f1) | (F.col("file") == f1) & (F.col("pos") > p1)
    return log.filter((F.col("file") >= f1) & (F.col("file") <= f2)).filter(after & ((F.col("file") < f2) | (F.col("pos") < p2)))


def outcomes(mapped: DataFrame, dry_run: bool = False, to: tuple[str, str] | None = None) -> DataFrame:
    """From rows with kept (a rule took them) and failed (publishing them fails): outcome, scheme and target by row."""
    scheme, target = routing.override(F.col("scheme"), F.col("target"), to)
    outcome = F.when(~F.col("kept"), "filtered").when(F.lit(dry_run), "would_publish").when(F.col("failed"), "failed").otherwise("published")
    return mapped.withColumns({"outcome": outcome, "scheme": scheme, "target": target})


def capped(log: DataFrame, order: list[Column], most: int = MAX_EVENTS) -> DataFrame:
    """The first rows in order, at most so many."""
    return log.orderBy(*order).limit(most)


def job_summary(done: DataFrame, most: int = MAX_EVENTS) -> DataFrame:
    """One row: counts by outcome, whether the cap was reached, and the status."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    out = done.agg(F.count(F.lit(1)).alias("read"), *[count(o) for o in ("published", "filtered", "failed", "would_publish")])
    return out.withColumns({"cap_reached": F.col("read") >= most, "status": F.lit("SUCCEEDED")})


@dataclass
class Job:
    id: str
    kind: str
    start: str
    end: str
    dry_run: bool = False
    status: str = "RUNNING"
    counts: dict[str, int] = field(default_factory=dict)
    cap_reached: bool = False
    error: str | None = None


class ReplayService:
    """Starts one replay at a time.  sources: by kind a function (start, end) -> DataFrame of rows as outcomes() takes them;
    publish gets the rows to send and returns those rows with failed.  A job never touches live checkpoints."""

    def __init__(self, sources: dict[str, Callable[[str, str], DataFrame]], publish: Callable[[DataFrame], DataFrame] | None = None, most: int = MAX_EVENTS, seconds: float = MAX_SECONDS):
        self.sources, self.publish, self.most, self.seconds = sources, publish, most, seconds
        self.jobs: dict[str, Job] = {}
        self._active = threading.Lock()

    def start(self, kind: str, start: str, end: str, dry_run: bool = False, to: tuple[str, str] | None = None, wait: bool = True) -> Job:
        if kind not in self.sources:
            raise UnsupportedReplay(f"no source {kind!r}; there are {sorted(self.sources)}")
        if not self._active.acquire(blocking=False):
            raise RuntimeError("a replay is running")
        job = self.jobs.setdefault(x := uuid.uuid4().hex, Job(x, kind, start, end, dry_run))
        thread = threading.Thread(target=self._run, args=(job, to), daemon=True)
        thread.start()
        if wait:
            thread.join()
        return job

    def status(self, job_id: str) -> Job | None:
        return self.jobs.get(job_id)

    def _run(self, job: Job, to: tuple[str, str] | None) -> None:
        spark = timer = None
        try:
            rows = self.sources[job.kind](job.start, job.end)
            spark = rows.sparkSession
            spark.sparkContext.setJobGroup(job.id, "replay", interruptOnCancel=True)
            timer = threading.Timer(self.seconds, lambda: spark.sparkContext.cancelJobGroup(job.id))
            timer.start()
            rows = capped(rows, [F.col("file"), F.col("pos"), F.col("seq")], self.most)
            if self.publish is not None and not job.dry_run:
                rows = self.publish(rows)
            r = job_summary(outcomes(rows, job.dry_run, to), self.most).first()
            job.counts = {k: r[k] for k in ("read", "published", "filtered", "failed", "would_publish")}
            job.cap_reached, job.status = r["cap_reached"], "SUCCEEDED"
        except Exception as e:  # noqa: BLE001  told in the job
            job.status, job.error = "FAILED", f"{type(e).__name__}: {e}"[:500]
        finally:
            if timer:
                timer.cancel()
            self._active.release()


def postgres_source(start: str, end: str) -> DataFrame:
    """A replication slot can't be read backwards."""
    raise UnsupportedReplay("Postgres WAL can't be replayed from a slot; replay an archive of raw records instead")
