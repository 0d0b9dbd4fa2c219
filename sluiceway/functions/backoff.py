"""Exponential back-off, as a Python class for drivers and as a Column for tables of attempts."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BackOff:
    """initial * multiplier^(attempt - 1), at most max; then times a random factor within jitter of 1 (so the longest
    delay is max * (1 + jitter)).  An attempt below 1 counts as 1.  Milliseconds."""

    initial_ms: float = 200
    max_ms: float = 30_000
    multiplier: float = 2.0
    jitter: float = 0.3

    def __post_init__(self):
        if self.initial_ms <= 0 or self.max_ms < self.initial_ms or self.multiplier < 1 or not 0 <= self.jitter <= 1:
            raise ValueError("back-off: initial > 0, max >= initial, multiplier >= 1 and jitter between 0 and 1 are needed")

    def delay_ms(self, attempt: int, rng: random.Random | None = None) -> float:
        power = min(max(attempt, 1) - 1, 1000)
        base = self.max_ms if power * (self.multiplier - 1) > 1e6 else min(self.initial_ms * min(self.multiplier**power, 1e300), self.max_ms)
        return base * (rng or random).uniform(1 - self.jitter, 1 + self.jitter) if self.jitter else base

    def column(self, attempt: Column, seed: int | None = None) -> Column:
        """The delay of each attempt; with jitter from a seeded random number by row."""
        base = F.least(F.lit(float(self.initial_ms)) * F.pow(F.lit(float(self.multiplier)), F.greatest(attempt, F.lit(1)) - 1), F.lit(float(self.max_ms)))
        return base * (F.lit(1 - self.jitter) + F.rand(seed) * (2 * self.jitter)) if self.jitter else base


#: Between attempts to publish; between attempts to connect; while a replication slot is busy.
PUBLISH = BackOff(100, 5_000, 2.0, 0.0)
RECONNECT = BackOff(200, 30_000, 2.0, 0.3)
SLOT_BUSY = BackOff(30_000, 300_000, 2.0, 0.0)
