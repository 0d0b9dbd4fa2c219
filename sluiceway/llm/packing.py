"""Packing documents into token sequences: bounded-space online packing, then a merge of what is left open.

Each partition keeps a fixed number of open windows.  A piece goes to the window that it fills best; when none has room,
the fullest is topped up with the head of the piece and emitted.  The windows still open at the end of the partitions
are merged in bundles of neighbouring partitions, so no step holds more than a fixed number of windows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

CAPACITY, OPEN, BUNDLE = 4096, 8, 64
#: A worker remembers the ids of so many words seen lately, and of as many seen before those.
CACHE_WORDS = 200_000
END_ID = 2
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A word of Latin letters and the marks after it: the pre-tokenizer parts it there, and its letters are composed already.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """How byte-level pre-tokenizers write a byte as a letter: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """Values by word, made when they are first asked for; after so many words only those seen lately stay."""

    def __init__(self, make, words: int):
        super().__init__()
        self.make, self.words, self.older = make, words, {}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        self[word] = value = self.make(word) if value is None else value
        return value

    def turn(self) -> None:
        if len(self) > self.words:
            self.older = dict(self)
            self.clear()


class WordTokens:
    """Token ids of whole texts by a tokenizer whose normaliser and pre-tokenizer never join what white space parts:
    a text's ids are those of its words, one after the other, so a word is tokenised once while it is remembered."""

    def __init__(self, spec: str, end_id: int = END_ID, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_str(spec), byte_letters()
        self.model = self.tokenizer.model
        self.end = np.array([end_id], "<u4").tobytes()
        self.known, self.stems = Remembered(self._word, words), Remembered(self._stem, words)

    def _word(self, word: str) -> bytes:
        if m := PLAIN.fullmatch(word):
            stem, marks = m.groups()
            return self.stems[stem.lower()] + (self.known[marks] if marks else b"")
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, stem: str) -> bytes:
        """Lower-case letters go to the model as they are."""
        told = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(told)], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian 32-bit numbers."""
        self.known.turn()
        self.stems.turn()
        known = self.known
        return [b"".join([known[w] for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ")]) + self.end for t in texts]


class Packer:
    """The open windows of one partition or bundle.  A piece is (doc_id, start, ids, doc_tokens); emit takes the pieces
    of a window that is done."""

    def __init__(self, emit, capacity: int = CAPACITY, windows: int = OPEN):
        self.emit, self.capacity, self.windows = emit, capacity, windows
        self.open: list[list] = []  # [tokens, pieces]

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        at = 0  # bytes of ids that have their place
        while n := (len(ids) - at) // 4:
            room = [(self.capacity - w[0], i) for i, w in enumerate(self.open) if self.capacity - w[0] >= n]
            if n >= self.capacity:  # a window of its own
                k, take = -1, self.capacity
            elif room:
                k, take = min(room)[1], n
            elif len(self.open) < self.windows:
                k, take = -1, n
            else:
                k = max(range(len(self.open)), key=lambda i: self.open[i][0])
                take = self.capacity - self.open[k][0]
            if k < 0:
                self.open.append([0, []])
                k = len(self.open) - 1
            w = self.open[k]
            w[0] += take
            w[1].append((doc_id, start + at // 4, ids[at : at + 4 * take], doc_tokens))
            if w[0] == self.capacity:
                self.emit(w[1])
                del self.open[k]
            at += 4 * take

    def merge(self) -> None:
        """Pour the emptiest open window into the fullest until one is left, and emit that."""
        while len(self.open) > 1:
            self.open.sort(key=lambda w: w[0])
            least = self.open.pop(0)
            for doc_id, start, ids, total in least[1]:
                at = 0
                while n := (len(ids) - at) // 4:
                    if not self.open:
                        self.open.append([0, []])
                    w = self.open[-1]
                    take = min(n, self.capacity - w[0])
                    w[0] += take
                    w[1].append((doc_id, start + at // 4, ids[at : at + 4 * take], total))
                    at += 4 * take
                    if w[0] == self.capacity:
                        self.emit(self.open.pop()[1])
        for w in self.open:
            self.emit(w[1])
        self.open = []


class Rows:
    """Gathers pieces as columns of an Arrow batch."""

    def __init__(self, first_sequence: int, with_ids: bool):
        self.sequence, self.with_ids = first_sequence, with_ids
        self.columns: list[list] = [[] for _ in range(9 if with_ids else 7)]

    def add(self, pieces: list, done: bool = True) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            row = (doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset)
            for c, v in zip(self.columns, (*row, None if done else ids, done) if self.with_ids else row, strict=True):
                c.append(v)
            offset += n
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "done"]
        types = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, types, strict=False)], names=names[: len(self.columns)])
        self.columns = [[] for _ in self.columns]
        return out


def pack(docs: DataFrame, spec: str, end_id: int = END_ID, capacity: int = CAPACITY, windows: int = OPEN, bundle: int = BUNDLE, words: int = CACHE_WORDS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, for docs (doc_id, text; other
    columns are ignored).  spec: the tokenizer as JSON.  words: how many words a
    task remembers; fewer take less memory and more time, and change no result.

    Every row of docs is a document of its own, also if its doc_id repeats or is null; a null or empty text has the end
    id alone.  A text of any length is cut at full windows.  All sequences but one by bundle are full.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows = WordTokens(shared.value, end_id, words), Rows(TaskContext.get().partitionId() << 32, True)
        packer = Packer(rows.add, capacity, windows)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc_id, 0, ids, len(ids) // 4)
            yield rows.batch()
        for _, pieces in packer.open:
            rows.add(pieces, done=False)
        yield rows.batch()

    first = materialize(docs.select("doc_id", "text").mapInArrow(tidy(placed), PIECE + ", ids binary, done boolean"), "pieces")

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        rows = Rows((1 << 62) + (key[0].as_py() << 32), False)
        packer = Packer(rows.add, capacity, windows)
        for r in t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        packer.merge()
        return pa.Table.from_batches([rows.batch()])

    names = [x.split()[0] for x in PIECE.split(", ")]
    left = first.filter(~F.col("done")).withColumn("bundle", F.floor(F.shiftright("sequence_id", 32) / bundle))
    return first.filter("done").select(*names).unionByName(left.groupBy("bundle").applyInArrow(merged, PIECE))
