"""A portable checkpoint store: one small JSON file by key, replaced atomically.  (Streaming queries have their own
checkpointLocation; this store is for positions that other programs read.)"""

from __future__ import annotations

import json
import os
import tempfile
import unicodedata
import warnings


def file_name(key: str) -> str:
    """Letters, decimal digits, dots and hyphens stay, all else becomes an underscore."""
    return "".join(c if c in ".-" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else "_" for c in key) + ".json"


class FileCheckpointStore:
    """load gives None for a file that is missing, unreadable, torn or of another key; save writes a temporary file, forces
    it to disk and renames it.  Temporary files of earlier runs are swept at the start; swept tells how that went."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        self.swept = {"deleted": 0, "failed": 0}
        for name in os.listdir(folder):
            if name.endswith(".tmp"):
                try:
                    os.remove(os.path.join(folder, name))
                    self.swept["deleted"] += 1
                except OSError:
                    self.swept["failed"] += 1

    def load(self, key: str) -> str | None:
        try:
            with open(os.path.join(self.folder, file_name(key)), encoding="utf-8") as f:
                entry = json.load(f)
            return entry["value"] if entry["key"] == key and isinstance(entry["value"], str) else None
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def save(self, key: str, value: str) -> None:
        to = os.path.join(self.folder, file_name(key))
        fd, tmp = tempfile.mkstemp(dir=self.folder, suffix=".tmp")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump({"key": key, "value": value}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, to)


class MemoryCheckpointStore:
    """For tests: counts loads and saves."""

    def __init__(self, values: dict[str, str] | None = None):
        self.values, self.loads, self.saves = dict(values or {}), 0, 0

    def load(self, key: str) -> str | None:
        self.loads += 1
        return self.values.get(key)

    def save(self, key: str, value: str) -> None:
        self.saves += 1
        self.values[key] = value


def store_or_warn(enabled: bool, store) -> tuple[object | None, int]:
    """The store to use and how many misconfigurations there are: enabled without a store is one."""
    if enabled and store is None:
        warnings.warn("checkpoints are enabled but there is no store; positions are not kept", stacklevel=2)
        return None, 1
    return (store if enabled else None), 0
