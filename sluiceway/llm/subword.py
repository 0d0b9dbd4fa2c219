"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

The vocabulary of a merge-type model is applied by an agenda: the best merge of a word comes first, and each candidate is
skipped if a keyed hash of the seed, the document, the occurrence's place in it, the place in the word and the two pieces
says so: each occurrence is drawn for itself.  The agendas of many words run side by side, one step of each at a time.
What a skip changes is which pieces spell a text, never the text.

What a word tries without a skip, or after its first one, is the same for all its occurrences and is remembered; the hashes
of an occurrence tell how far it goes along.  An occurrence with more skips has an agenda of its own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import tidy
from .shingles import mix

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Longer words have an agenda of their own; one step of all words side by side costs as much as they are long.
LONG = 64
#: A worker forgets its words when it remembers so many words, or so many tries of words.
CACHE_WORDS, CACHE_TRIES = 400_000, 8_000_000
#: Occurrences decided on at once.
PART = 1 << 16
#: Rows that a worker encodes or decodes at once.
ROWS = 1024


class Vocabulary:
    """The pieces of a merge-type model with byte fallback, and its merges as a sorted table."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: normal, byte or other, for each piece."""
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes: list[bytes] = []
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "byte":
                self.byte_ids[int(p[3:-1], 16)] = i
            self.bytes.append(bytes([int(p[3:-1], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"")
        order = np.array(scores)
        joined = sorted(
            ((self.ids[p[:k]] << 32 | self.ids[p[k:]], i, order[i]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        )
        # merges, and a last one that no pair has for empty slots of the table of hashes
        self.pair = np.array([j[0] for j in joined] + [-1], np.int64)
        self.made = np.array([j[1] for j in joined] + [-1], np.int64)
        self.score = np.array([j[2] for j in joined] + [-np.inf])
        self.bits = max(8, (8 * len(joined)).bit_length())
        self.slots = np.full((1 << self.bits) + len(joined) + 1, len(joined), np.int32)
        left = np.arange(len(joined))
        slot = self._slot(self.pair[:-1])
        while len(left):  # each merge to the first free slot from its own on
            free = self.slots[slot] == len(joined)
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.slots[slot[first]] = left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], slot[rest] + 1
        points = [(ord(p), i) for p, i in self.ids.items() if len(p) == 1]
        self.point_ids = np.full(max((p for p, _ in points), default=0) + 2, -1, np.int64)  # the last one for all above
        for p, i in points:
            self.point_ids[p] = i

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, pair: np.ndarray) -> np.ndarray:
        """The number of the merge of each pair of pieces; that of the last, empty one if there is none."""
        slot = self._slot(pair)
        found = self.slots[slot]
        none = len(self.pair) - 1
        lost = np.flatnonzero((self.pair[found] != pair) & (found != none))
        while len(lost):
            slot[lost] += 1
            found[lost] = self.slots[slot[lost]]
            lost = lost[(self.pair[found[lost]] != pair[lost]) & (found[lost] != none)]
        return found

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in range(n)]
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], kinds)

    def decode(self, ids: list[int]) -> str:
        """The text whose encoding the ids are: their bytes without the space put before a text."""
        return b"".join([self.bytes[i] for i in ids])[1:].decode("utf-8", "surrogatepass")

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, all at once; null for null."""
        if not hasattr(self, "flat"):
            self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
            self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes), np.uint8)
        which, ends = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy()))
        sizes = self.sizes[which]
        data = self.flat[_ranges(self.starts[which], sizes)]
        cuts = np.append(0, np.cumsum(sizes))[ends]
        keep = np.ones(len(data), bool)
        keep[cuts[:-1][np.diff(cuts) > 0]] = False  # the space put before a text
        cuts = cuts - np.append(0, np.cumsum(np.diff(cuts) > 0))
        out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.large_string()).cast(pa.string())
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), out)


PARTS = re.compile(f"{MARK}*[^{MARK}\n]+\n?|{MARK}+\n?|\n")


def words_of(text: str) -> list[str]:
    """The parts of a text that no merge goes across: marks for spaces, what follows them up to the next space, and a
    line end.  An empty part stands for a mark that was in the text itself; it is spelt in bytes."""
    out: list[str] = []
    for k, part in enumerate(text.split(MARK)):
        part = part.replace(" ", MARK)
        out += [""] * (k > 0)
        out += PARTS.findall(part if k else MARK + part)
    return out if text else []


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of many texts, as words_of finds them, and how many each text has."""
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        every = [words_of(t or "") for t in texts.to_pylist()]
        return pa.array([w for words in every for w in words], pa.large_string()), np.fromiter(map(len, every), np.int64, len(every))
    full = pc.if_else(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0), pc.binary_join_element_wise(" ", texts, ""), "").cast(pa.large_string())
    ends = np.append(0, np.cumsum(pc.binary_length(full).to_numpy(zero_copy_only=False))).astype(np.int64)
    _, offsets, data = full.buffers()
    if not ends[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    data = data.slice(int(np.frombuffer(offsets, np.int64)[full.offset]), int(ends[-1]))
    byte = np.frombuffer(data, np.uint8)
    begins = np.ones(len(byte), bool)
    begins[1:] = (byte[1:] == 32) & (byte[:-1] != 32) | (byte[:-1] == 10)
    begins[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(begins)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(byte)).astype(np.int64)), data])
    return words, np.diff(np.searchsorted(starts, ends))


def _try(pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for a candidate merge, by its place in the word and its pieces."""
    with np.errstate(over="ignore"):
        return pos.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))


def _keyed(seed: int, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key.astype(np.uint64) + np.uint64(seed & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15))


def _skipped(keyed: np.ndarray, tries: np.ndarray, dropout: float) -> np.ndarray:
    """Whether a candidate merge is skipped, by a keyed hash."""
    if dropout <= 0:
        return np.zeros(len(tries), bool)
    with np.errstate(over="ignore"):
        return (mix(keyed + tries) >> np.uint64(11)).astype(float) / 2.0**53 < dropout


def _symbols(words: list[str], v: Vocabulary) -> np.ndarray:
    """The pieces of single characters; -1 - code point for a character without one."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ids = v.point_ids[np.minimum(points, len(v.point_ids) - 1)]
    return np.where(ids >= 0, ids, -1 - points)


def _candidates(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Score (minus infinity: none) and piece of the merge of two pieces."""
    at = v.find(np.where((left >= 0) & (right >= 0), left << 32 | right, -1))
    return v.score[at], v.made[at]


def agenda(word: str, key: int, v: Vocabulary, seed: int, dropout: float) -> list[int]:
    """The pieces of one word of any length, by a heap of candidate merges."""
    sym = _symbols([word], v).tolist()
    n = len(sym)
    prev, nxt, heap = [i - 1 for i in range(n)], [i + 1 for i in range(n)], []

    def offer(pairs: list[tuple[int, int]]) -> None:
        a, b = np.array([sym[i] for i, _ in pairs], np.int64), np.array([sym[j] for _, j in pairs], np.int64)
        score, made = _candidates(a, b, v)
        for k in np.flatnonzero(score > -np.inf).tolist():
            heapq.heappush(heap, (-score[k], *pairs[k], sym[pairs[k][0]], sym[pairs[k][1]], int(made[k])))

    if n > 1:
        offer([(i, i + 1) for i in range(n - 1)])
    one = lambda x: np.array([x], np.int64)
    keyed = _keyed(seed, one(key))
    while heap:
        _, i, j, a, b, made = heapq.heappop(heap)
        if sym[i] != a or nxt[i] != j or sym[j] != b or _skipped(keyed, _try(one(i), one(a), one(b)), dropout)[0]:
            continue
        sym[i], sym[j] = made, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        if new := [(prev[i], i)] * (prev[i] >= 0) + [(i, nxt[i])] * (nxt[i] < n):
            offer(new)
    return [x for x in sym if x is not None]


def side_by_side(words: list[str], keys: np.ndarray, v: Vocabulary, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of short words and the word of each, where a keyed hash skips candidates."""
    keyed = _keyed(seed, keys)
    return _agendas(words, v, lambda _, word, tries: _skipped(keyed[word], tries, dropout))


def _agendas(words: list[str], v: Vocabulary, skips: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of short words and the word of each, all agendas one step at a time: word by word the best candidate
    (of equal ones the first) is skipped or merged, as skips says of the step, the words and their tries."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sym, word = _symbols(words, v), np.repeat(np.arange(len(words)), sizes)
    pos = np.arange(len(sym)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    score, made = _candidates(sym, np.append(sym[1:], -1), v)  # of a symbol and the next one
    score[np.append(word[1:] != word[:-1], len(sym) > 0)[: len(sym)]] = -np.inf
    done: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(sym):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        best = np.maximum.reduceat(score, starts)
        counts = np.diff(starts, append=len(sym))
        alive = np.repeat(best > -np.inf, counts)
        if not alive.all():
            done.append((word[~alive], sym[~alive]))
        top = np.flatnonzero(alive & (score == np.repeat(best, counts)))
        at = top[np.diff(word[top], prepend=-1) != 0]
        skip = skips(step, word[at], _try(pos[at], sym[at], sym[np.minimum(at + 1, len(sym) - 1)]))
        step += 1
        score[at[skip]] = -np.inf
        m = at[~skip]
        sym[m] = made[m]
        alive[m + 1] = False
        m = np.cumsum(alive)[m] - 1
        sym, word, pos, score, made = sym[alive], word[alive], pos[alive], score[alive], made[alive]
        back = m[m > 0] - 1
        new = np.concatenate([m, back[word[back] == word[back + 1]]])  # a skipped candidate beside a merge makes room for another
        right = np.minimum(new + 1, len(sym) - 1)
        score[new], made[new] = _candidates(sym[new], sym[right], v)
        score[new[(right == new) | (word[right] != word[new])]] = -np.inf
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, s = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(w, kind="stable")
    return w[order], s[order]


def _spelt(sym: Iterable[int], v: Vocabulary) -> bytes:
    ids = [i for s in sym for i in ([s] if s >= 0 else v.byte_ids[list(chr(-1 - s).encode("utf-8", "surrogatepass"))])]
    return np.array(ids, "<u4").tobytes()


def _cut(which: np.ndarray, sym: np.ndarray, words: int, v: Vocabulary) -> list[bytes]:
    """The ids of each of so many words, from their pieces."""
    ends = np.searchsorted(which, np.arange(words + 1)).tolist()
    odd = np.zeros(words, bool)
    odd[which[sym < 0]] = True
    data = np.maximum(sym, 0).astype("<u4").tobytes()
    return [_spelt(sym[a:b].tolist(), v) if o else data[4 * a : 4 * b] for a, b, o in zip(ends[:-1], ends[1:], odd.tolist(), strict=True)]


def encode_words(words: list[tuple[str, int]], v: Vocabulary, seed: int, dropout: float) -> list[bytes]:
    """The ids of each (word, key), as little-endian 32-bit numbers.  key: a signed number for the occurrence."""
    keys = np.array([k for _, k in words], np.int64)
    short = [i for i, (w, _) in enumerate(words) if 0 < len(w) <= LONG]
    out: list[bytes] = [b""] * len(words)
    for i, ids in zip(short, _cut(*side_by_side([words[i][0] for i in short], keys[short], v, seed, dropout), len(short), v), strict=True):
        out[i] = ids
    for i, (w, k) in enumerate(words):
        if not w:
            out[i] = _spelt([-1 - ord(MARK)], v)
        elif len(w) > LONG:
            out[i] = _spelt(agenda(w, k, v, seed, dropout), v)
    return out


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + len(more), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Encoder:
    """Encodes texts with one seed and dropout.  It remembers what doesn't depend on the occurrence: of each short word the
    tries and ids without a skip, and of each of these tries the further tries and the ids if it is the only one skipped."""

    def __init__(self, v: Vocabulary, seed: int, dropout: float, words: int = CACHE_WORDS, tries: int = CACHE_TRIES):
        self.v, self.seed, self.dropout, self.words, self.most = v, seed, dropout, words, tries
        self._forget()

    def _forget(self) -> None:
        self.paths: dict[str, int] = {}
        self.tries, self.after, self.ids = _Grown(np.uint64), _Grown(np.int32), _Grown(np.uint32)  # after: the path if skipped
        self.tries_at, self.tries_n, self.ids_at, self.ids_n = (_Grown(np.int64) for _ in range(4))

    def _learn(self, words: list[str], at: np.ndarray) -> np.ndarray:
        """The new paths of words that skip nothing but the try of number at (negative: nothing at all)."""
        tried: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]

        def skips(step: int, word: np.ndarray, tries: np.ndarray) -> np.ndarray:
            left = at[word] < step
            tried.append((word[left], tries[left]))
            return at[word] == step

        ids = _cut(*_agendas(words, self.v, skips), len(words), self.v)
        word, tries = (np.concatenate(x) for x in zip(*tried, strict=True))
        sizes = np.bincount(word, minlength=len(words))
        tries = tries[np.argsort(word, kind="stable")]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        new = self.tries_at.n + np.arange(len(words))
        self.tries_at.add(self.tries.n + np.cumsum(sizes) - sizes)
        self.tries_n.add(sizes)
        self.ids_at.add(self.ids.n + np.cumsum(lengths) - lengths)
        self.ids_n.add(lengths)
        self.tries.add(tries)
        self.after.add(np.full(len(tries), -1))
        self.ids.add(np.frombuffer(b"".join(ids), "<u4"))
        return new

    def _first(self, keyed: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences that skip a try of their path, and the first such try."""
        sizes = self.tries_n.data[path]
        at = _ranges(self.tries_at.data[path], sizes)
        who = np.repeat(np.arange(len(path)), sizes)
        hit = np.flatnonzero(_skipped(keyed[who], self.tries.data[at], self.dropout))
        hit = hit[np.diff(who[hit], prepend=-1) != 0]
        return who[hit], at[hit]

    def _encode(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of occurrences of words, one after the other, and how many each has."""
        listed = pa.array(words, pa.large_string()).dictionary_encode()
        return self._spell(listed.dictionary.to_pylist(), listed.indices.to_numpy(), keys)

    def _known(self, words: list[str]) -> np.ndarray:
        """The path of each of some different words without a skip; -1 for those that have an agenda of their own."""
        if len(self.paths) > self.words or self.tries.n > self.most:
            self._forget()
        path = np.fromiter(map(self.paths.get, words, repeat(-1)), np.int64, len(words))
        lack = [i for i in np.flatnonzero(path < 0).tolist() if 0 < len(words[i]) <= LONG]
        new = [words[i] for i in lack]
        path[lack] = self._learn(new, np.full(len(new), -1))
        self.paths.update(zip(new, path[lack].tolist(), strict=True))
        return path

    def _spell(self, words: list[str], which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the words of those numbers."""
        plain = self._known(words)
        parts = [self._part(words, plain, which[i : i + PART], keys[i : i + PART]) for i in range(0, max(1, len(which)), PART)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids, sizes

    def _part(self, words: list[str], plain: np.ndarray, which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        path = plain[which]
        if self.dropout > 0:
            keyed = _keyed(self.seed, keys)
            known = np.flatnonzero(path >= 0)
            who, at = self._first(keyed[known], path[known])
            who = known[who]
            lack, one = np.unique(at[self.after.data[at] < 0], return_index=True)
            of = who[self.after.data[at] < 0][one]
            learnt = self._learn([words[i] for i in which[of].tolist()], lack - self.tries_at.data[path[of]])
            self.after.data[lack] = learnt
            path[who] = self.after.data[at]
            path[who[self._first(keyed[who], path[who])[0]]] = -1
        own, known = np.flatnonzero(path < 0), np.flatnonzero(path >= 0)
        spelt = encode_words([(words[i], k) for i, k in zip(which[own].tolist(), keys[own].tolist(), strict=True)], self.v, self.seed, self.dropout)
        sizes = np.zeros(len(path), np.int64)
        sizes[known] = self.ids_n.data[path[known]]
        sizes[own] = np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), "<u4")
        out[_ranges(starts[known], sizes[known])] = self.ids.data[_ranges(self.ids_at.data[path[known]], sizes[known])]
        out[_ranges(starts[own], sizes[own])] = np.frombuffer(b"".join(spelt), "<u4")
        return out, sizes

    def encode_lists(self, keys: np.ndarray, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (null: none), which has a 64-bit key."""
        words, counts = _split(texts)
        ends = np.append(0, np.cumsum(counts))
        with np.errstate(over="ignore"):
            base = mix(keys.astype(np.int64).view(np.uint64)) * np.uint64(3) + mix(np.array([self.seed & (2**64 - 1)], np.uint64))
            places = mix(np.repeat(base, counts) + (np.arange(ends[-1]) - np.repeat(ends[:-1], counts)).astype(np.uint64))
        listed = words.dictionary_encode()
        spelt = pc.replace_substring(listed.dictionary, " ", MARK).to_pylist()
        ids, sizes = self._spell(spelt, listed.indices.to_numpy(), places.view(np.int64))
        cuts = np.append(0, np.cumsum(sizes))[ends]
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32)))

    def encode(self, keys: list[int | None], texts: list[str | None]) -> list[bytes]:
        """The same as little-endian 32-bit numbers."""
        ids = self.encode_lists(np.array([k or 0 for k in keys], np.int64), pa.array(texts, pa.string()))
        flat, cuts = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(docs: DataFrame, model: str, seed: int = 0, dropout: float = 0.1, source: bool = False) -> DataFrame:
    """doc_id, ids for every row of docs (doc_id, text; other columns are ignored): the token ids; with source also the text
    that went in.  model: the path of a merge-type model, read on the driver.

    The same seed, doc_id and text always give the same ids; dropout 0 gives the model's own.  A null or empty text has no
    ids; rows that repeat a doc_id are encoded alike, a null doc_id counts as 0."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return docs.select("doc_id", "text").mapInArrow(tidy(_encoded(shared, seed, dropout, source)), "doc_id long, ids array<int>" + ", source string" * source)


def _encoded(shared, seed: int, dropout: float, source: bool):
    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, seed, dropout)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = encoder.encode_lists(part.column(0).fill_null(0).to_numpy(), part.column(1))
                names = ["doc_id", "ids"] + ["source"] * source
                yield pa.RecordBatch.from_arrays([part.column(0), ids, part.column(1)][: len(names)], names=names)

    return encoded


def decode(tokens: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """The rows of tokens with the text of their ids in a column more, or in place of one of that name.  Null ids give a null
    text, no ids an empty one; the ids need not come from encode, but an id that the model doesn't have is an error, and so
    are ids whose bytes aren't text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rest = [c for c in tokens.columns if c != to]
    at, schema = rest.index(ids), tokens.select(*rest).schema.add(to, "string")
    return tokens.select(*rest).mapInArrow(tidy(_decoded(shared, at, [*rest, to])), schema)


def _decoded(shared, at: int, names: list[str]):
    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, shared.value.texts(part.column(at))], names=names)

    return decoded


def round_trip(docs: DataFrame, model: str, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """doc_id, ids, source, text: encode with its source and then decode, in one pass of Python workers.  text comes from the
    ids alone."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    encoded, decoded = _encoded(shared, seed, dropout, True), _decoded(shared, 1, ["doc_id", "ids", "source", "text"])
    return docs.select("doc_id", "text").mapInArrow(tidy(lambda batches: decoded(encoded(batches))), "doc_id long, ids array<int>, source string, text string")
