"""Checkpoint store, configuration and connection helpers."""

import os

import pytest

from sluiceway.checkpoints import FileCheckpointStore, MemoryCheckpointStore, store_or_warn
from sluiceway.config import Config, NotSupported, build_source
from sluiceway.functions.backoff import BackOff
from sluiceway.sources import connect

FAST = BackOff(1, 1, 1.0, 0.0)


def test_store(tmp_path):
    s = FileCheckpointStore(str(tmp_path / "c"))
    assert s.load("binlog:65536") is None
    s.save("binlog:65536", "mysql-bin.000004:891")
    s.save("binlog:65536", 'a"b\\c\n\r')
    assert s.load("binlog:65536") == 'a"b\\c\n\r' and FileCheckpointStore(str(tmp_path / "c")).load("binlog:65536") == 'a"b\\c\n\r'
    assert s.load("binlog_65536") is None  # the same file, another key
    path = tmp_path / "c" / "binlog_65536.json"
    for text in ("", "{", '{"key":"binlog:65536"}', "[]", '{"key":"binlog:65536","value":1}'):
        path.write_text(text)
        assert s.load("binlog:65536") is None
    assert not [f for f in os.listdir(tmp_path / "c") if f.endswith(".tmp")]


def test_orphans_are_swept(tmp_path):
    (tmp_path / "a.tmp").write_text("x")
    (tmp_path / "b.tmp").mkdir()
    assert FileCheckpointStore(str(tmp_path)).swept == {"deleted": 1, "failed": 1}


def test_memory_store_and_guard():
    m = MemoryCheckpointStore()
    m.save("k", "v")
    assert m.load("k") == "v" and (m.loads, m.saves) == (1, 1)
    assert store_or_warn(True, m) == (m, 0) and store_or_warn(False, m) == (None, 0)
    with pytest.warns(UserWarning):
        assert store_or_warn(True, None) == (None, 1)


def test_config(spark, tmp_path):
    c = Config.from_dict({"source": "postgres_rows", "password": "x", "url": "u", "retry": {"initial_ms": 5}, "mappings": [{"table": "t", "routing": {"sink": "sns://t"}}]})
    assert c.retry.publish_attempts == 5 and c.slot_options()["format-version"] == "2" and c.mappings[0].table == "t"
    info = c.info()
    assert info["mappings"] == ["t"] and "password" not in info and "url" not in info
    for bad in ({"nothing": 1}, {"lag_interval_ms": 10}, {"retry": {"jitter": 2}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)
    for source in ("oracle", "sqlserver"):
        with pytest.raises(NotSupported):
            build_source(spark, Config(source=source, path=str(tmp_path)))
    with pytest.raises(ValueError):
        build_source(spark, Config(source="x"))
    assert "format-version" not in Config(format_version="V1").slot_options()


def test_connecting():
    slept, states = [], ["55006", "55006", None]

    def open_():
        if s := states.pop(0):
            raise connect.SourceError(s)
        return "open"

    assert connect.open_with_retry(open_, FAST, sleep=slept.append) == "open" and len(slept) == 2

    def busy():
        raise connect.SourceError("55006")

    def other():
        raise connect.SourceError("08006")

    with pytest.raises(connect.SourceError):
        connect.open_with_retry(busy, FAST, limit=3, sleep=slept.append)
    with pytest.raises(connect.SourceError):
        connect.open_with_retry(other, FAST, sleep=slept.append)

    def exists():
        raise connect.SourceError("42710")

    assert connect.ensure_slot(lambda: None) is True and connect.ensure_slot(exists) is False
    with pytest.raises(connect.SourceError):
        connect.ensure_slot(other)


def test_restarts():
    left, slept = [connect.SourceError("57P03"), OSError("x")], []

    def run():
        if left:
            raise left.pop(0)

    assert connect.run_with_restart(run, back_off=FAST, sleep=slept.append) == 3 and slept == [5.0, 0.001]

    def never():
        raise OSError("x")

    with pytest.raises(OSError):
        connect.run_with_restart(never, limit=2, back_off=FAST, sleep=slept.append)


def test_lag_sampler():
    import math

    from sluiceway.ports import LagSampler

    answers = [None, 5, None, OSError("x"), 7]

    def probe():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    s = LagSampler(probe, 1000)
    got = [s.sample() for _ in range(5)]
    assert math.isnan(got[0]) and got[1:] == [5, 5, 5, 7]
    with pytest.raises(ValueError):
        LagSampler(probe, 10)
    answers.append(9)
    s.start()
    s.start()
    deadline = __import__("time").monotonic() + 10
    while s.value != 9 and __import__("time").monotonic() < deadline:
        __import__("time").sleep(0.05)
    s.stop()
    assert s.value == 9
