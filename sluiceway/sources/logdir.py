"""A Python data source: a folder of numbered log segments, read as a stream with explicit acknowledgement.

Each segment is a text file named <number>.log with one record a line; offsets are counts of segments.  It stands for a
replication connection: commit(end) is the acknowledgement, and trails the batch by one, so delivery is at least once.
"""

from __future__ import annotations

import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SEGMENT = re.compile(r"([0-9]+)\.log")


class Segment(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def segments(path: str) -> list[int]:
    return sorted(int(m[1]) for f in os.listdir(path) if (m := SEGMENT.fullmatch(f)))


def _lines(path: str, number: int):
    with open(os.path.join(path, f"{number}.log"), encoding="utf-8") as f:
        for i, line in enumerate(f):
            yield number, i, line.rstrip("\n")


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.at = path, most, None

    def initialOffset(self) -> dict:
        """Asked of a new query only, which begins at the first segment."""
        self.at = 0
        return {"next": 0}

    def _acked(self) -> int:
        """How far a former run of the query had acknowledged: at most one batch behind what it had read."""
        try:
            with open(os.path.join(self.path, "acked"), encoding="utf-8") as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def latestOffset(self) -> dict:
        """At most so many segments more than last time, on the first start and after a restart too: admission control."""
        last = max(segments(self.path), default=-1) + 1
        if self.at is None:
            self.at = self._acked()
        self.at = max(self.at, min(last, self.at + self.most) if self.most else last)
        return {"next": self.at}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.at = max(self.at or 0, end["next"])
        return [Segment(self.path, n) for n in segments(self.path) if start["next"] <= n < end["next"]]

    def read(self, partition: Segment):
        yield from _lines(partition.path, partition.number)

    def commit(self, end: dict) -> None:
        with open(os.path.join(self.path, "acked"), "w", encoding="utf-8") as f:
            f.write(str(end["next"]))


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Segment]:
        return [Segment(self.path, n) for n in segments(self.path)]

    def read(self, partition: Segment):
        yield from _lines(partition.path, partition.number)


class LogFolder(DataSource):
    """spark.read / readStream.format("logfolder").load(path): segment, line, raw.  Option maxSegmentsPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "logfolder"

    def schema(self) -> str:
        return "segment long, line long, raw string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("maxSegmentsPerTrigger", 0)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])
