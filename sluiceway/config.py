"""Configuration: sections with defaults, sources from it, and a summary without secrets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from .functions.backoff import BackOff
from .model import TableMapping, mappings_from_config

SECRET = ("password", "secret", "token", "credential")
SOURCES = ("postgres_messages", "postgres_rows", "binlog", "outbox")


class NotSupported(NotImplementedError):
    pass


@dataclass
class Retry:
    initial_ms: int = 200
    max_ms: int = 30_000
    multiplier: float = 2.0
    jitter: float = 0.3
    publish_attempts: int = 5
    publish_initial_ms: int = 100
    publish_max_ms: int = 5_000

    def back_off(self) -> BackOff:
        return BackOff(self.initial_ms, self.max_ms, self.multiplier, self.jitter)


@dataclass
class Config:
    source: str = "postgres_messages"
    slot: str = "outbox_slot"
    format_version: str = "V2"
    url: str = ""
    user: str = ""
    password: str = ""
    path: str = ""
    files_per_trigger: int | None = None
    idle_sleep_ms: int = 100
    lag_interval_ms: int = 10_000
    max_idle_ms: int = 600_000
    dead_letters: bool = False
    checkpoints: bool = False
    dlq_replay: bool = False
    replay: bool = False
    replay_max_events: int = 100_000
    replay_max_seconds: int = 600
    retry: Retry = field(default_factory=Retry)
    mappings: tuple[TableMapping, ...] = ()

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        v = dict(values)
        if "retry" in v:
            v["retry"] = Retry(**v["retry"])
        if "mappings" in v:
            v["mappings"] = mappings_from_config(v["mappings"])
        out = cls(**v)
        if out.lag_interval_ms < 1000:
            raise ValueError("the lag interval must be a second or more")
        out.retry.back_off()
        return out

    def slot_options(self) -> dict[str, str]:
        """Options of the replication slot's output."""
        out = {"include-xids": "true", "include-lsn": "true"}
        return out | ({"format-version": "2"} if self.format_version == "V2" else {})

    def info(self) -> dict:
        """What is configured, without secrets or mapping details."""
        d = asdict(self)
        d["mappings"] = sorted(m.table for m in self.mappings)
        return {k: v for k, v in d.items() if not any(s in k for s in SECRET) and k not in ("url", "user")}


def build_source(spark: SparkSession, config: Config, catalog: DataFrame | None = None) -> DataFrame:
    """The stream of events of a configuration: a row source with its mappings, or messages, or outbox rows.  Raw records are
    read from a folder of text files, the stand-in for a replication socket.  catalog: the column names of binlog tables."""
    from .operators import mapping
    from .streaming import pipelines

    if config.source in ("oracle", "sqlserver"):
        raise NotSupported(f"{config.source} is not supported")
    if config.source not in SOURCES:
        raise ValueError(f"no source {config.source!r}; there are {SOURCES}")
    if config.source == "outbox":
        return pipelines.outbox_events(spark, config.path, config.files_per_trigger)
    raw = pipelines.raw_records(spark, config.path, config.files_per_trigger)
    if config.source == "postgres_messages":
        return pipelines.message_events(raw, config.format_version)
    if config.source == "binlog":
        return mapping.apply(pipelines.binlog_changes(raw, catalog), config.mappings, "json")
    return pipelines.row_events(raw, config.mappings, config.format_version)
