"""Retry around opening a source, and the boundary to replication sockets, which Spark can't open."""

from __future__ import annotations

import time
from collections.abc import Callable

from ..functions.backoff import SLOT_BUSY, BackOff

BUSY, EXISTS, RECOVERY = "55006", "42710", "57P03"


class SourceError(RuntimeError):
    def __init__(self, state: str, message: str = ""):
        super().__init__(f"{state} {message}".strip())
        self.state = state


def open_with_retry(connect: Callable[[], object], back_off: BackOff = SLOT_BUSY, limit: int | None = None, sleep: Callable[[float], None] = time.sleep):
    """connect() again while the slot is busy, at most limit attempts (None: no limit).  Other errors are raised."""
    attempt = 0
    while True:
        attempt += 1
        try:
            return connect()
        except SourceError as e:
            if e.state != BUSY or limit is not None and attempt >= limit:
                raise
            sleep(back_off.delay_ms(attempt) / 1000)


def ensure_slot(create: Callable[[], None]) -> bool:
    """Create a slot; whether it is new."""
    try:
        create()
        return True
    except SourceError as e:
        if e.state != EXISTS:
            raise
        return False


def run_with_restart(run: Callable[[], None], limit: int = 30, recovery_seconds: float = 5.0, back_off: BackOff = BackOff(200, 30_000, 2.0, 0.0), sleep: Callable[[float], None] = time.sleep) -> int:
    """run() again after an error, at most limit attempts; a server in recovery is given a fixed time.  Returns the
    number of attempts."""
    for attempt in range(1, limit + 1):
        try:
            run()
            return attempt
        except Exception as e:
            if attempt == limit:
                raise
            sleep(recovery_seconds if getattr(e, "state", None) == RECOVERY else back_off.delay_ms(attempt) / 1000)
    return limit
