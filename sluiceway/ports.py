"""What users can plug in, as protocols; and the sampler of a lag probe."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame


class EventSource(Protocol):
    """A stream or table of events (model.EVENT); its acknowledgement is the streaming commit."""

    def events(self) -> DataFrame: ...


class RowSource(Protocol):
    """A stream or table of row changes (model.ROW_CHANGE)."""

    def changes(self) -> DataFrame: ...


class EventSink(Protocol):
    """Publishes one event (a dict of its columns) and raises if it can't; never retries itself."""

    def __call__(self, event: dict) -> None: ...


class DeadLetter(Protocol):
    def __call__(self, event: dict, cause: Exception) -> None: ...


class CheckpointStore(Protocol):
    def load(self, key: str) -> str | None: ...

    def save(self, key: str, value: str) -> None: ...


class LagProbe(Protocol):
    """Bytes behind, or None if that isn't known now."""

    def __call__(self) -> int | None: ...


class Replayer(Protocol):
    """Rows between two positions, as operators.replay.outcomes takes them."""

    def __call__(self, start: str, end: str) -> DataFrame: ...


class LetterQueue(Protocol):
    """A queue of dead letters: its messages (receipt, body, in_flight), and deleting some; delete returns those deleted."""

    def messages(self) -> DataFrame: ...

    def delete(self, receipts: DataFrame) -> DataFrame: ...


class Serializer(Protocol):
    """A payload map as text."""

    def __call__(self, payload: Column) -> Column: ...


class LagSampler:
    """Asks a probe at a fixed rate (a second or more, first after one interval) and keeps the last known value: NaN
    before the first, and unchanged while the probe fails or doesn't know."""

    def __init__(self, probe: Callable[[], int | None], interval_ms: int = 10_000):
        if interval_ms < 1000:
            raise ValueError("the interval must be a second or more")
        self.probe, self.seconds, self.value = probe, interval_ms / 1000, math.nan
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def sample(self) -> float:
        try:
            got = self.probe()
        except Exception:  # noqa: BLE001  a probe may raise anything
            got = None
        if got is not None:
            self.value = float(got)
        return self.value

    def start(self) -> None:
        if self._thread is None:
            self._thread = threading.Thread(target=self._loop, name="lag-sampler", daemon=True)
            self._thread.start()

    def _loop(self) -> None:
        while not self._stop.wait(self.seconds):
            self.sample()

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join(self.seconds + 1)
