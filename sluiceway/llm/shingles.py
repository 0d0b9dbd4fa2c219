"""Sets of word-shingle hashes of many texts at once, in numpy over the bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer text is handled alone).
PART = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, each to another one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(start: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(start, start + n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTES = _odd(1 << 20, 256)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]  # A-Z count as lower case
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACES = _odd(1 << 30, 1 << 10)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each text the ascending distinct 64-bit hashes of its shingles: runs of so many words between ASCII white
    space, A-Z lower-cased.  A text with fewer words has its whole sequence as the one shingle; null and blank none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, "right")) - 1)
        yield from _part(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
        i = j


def _part(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    global _PLACES
    empty, docs = np.zeros(0, np.uint64), len(offsets) - 1
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inside = offsets[:-1][offsets[:-1] < len(data)]
    start[inside] = solid[inside]  # a word ends with its text
    at = np.flatnonzero(solid)
    if not len(at):
        yield from (empty for _ in range(docs))
        return
    begins = np.flatnonzero(start[at])  # among the solid bytes
    sizes = np.diff(begins, append=len(at))
    if sizes.max() > len(_PLACES):
        _PLACES = _odd(1 << 30, int(sizes.max()))
    with np.errstate(over="ignore"):
        value = _BYTES[data[at]]
        value *= _PLACES[np.arange(len(at)) - np.repeat(begins, sizes)]
        h = mix(np.add.reduceat(value, begins) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        weight = _odd(1 << 40, words)
        run = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            run += h[k : k + len(run)] * weight[k]
        run = mix(run)
        first = np.searchsorted(at[begins], offsets)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(run[a : b - words + 1])
            elif b > a:
                yield mix((h[a:b] * weight[: b - a]).sum(keepdims=True) + np.uint64((b - a) * 0x2545F4914F6CDD1D & (2**64 - 1)))
            else:
                yield empty


def set_key(s: np.ndarray) -> bytes:
    """20 bytes that stand for a set: its size, then a digest.  Keys are in order of size."""
    return len(s).to_bytes(4, "big") + hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least size that a set may have beside one of n: J >= num / den needs at least that part of n."""
    return -(-n * num // den)


def needed_overlap(n, m, num: int, den: int):
    """The least intersection of sets of n and m with J >= num / den."""
    return -(-(n + m) * num // (num + den))
