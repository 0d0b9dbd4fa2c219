"""Quality classifier: a generalised additive model with pairwise interactions.

Training cycles over the features; each turn fits a shallow tree on one binned feature (later on one pair) to the current
residuals and adds it to that feature's lookup table.  A score is the sum of one entry from each table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Labelled rows to fit on: the sample is bounded, taken by hash of doc_id.
MAX_TRAIN = 20_000

NAMES = [
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digit", "sentence_marks", "exclamations",
    "pipes", "symbols", "non_ascii", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "log_lines", "words_by_line",
    "words_by_sentence", "capital_words", "compression", "marks_by_word",
]
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"-", "!", "|", "#$%&*@^~<>=+_\\/{}[]()`"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 7


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of NAMES; an empty or null text gives zeros."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n, m = len(b), len(words)
    if not m:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_CLASS[np.frombuffer(b, np.uint8)], minlength=8) / n
    sizes = np.fromiter(map(len, words), np.int64, m)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = b.split(b"\n")
    ends = b.count(b".") + b.count(b"!") + b.count(b"?")
    capital = sum(map(bytes.istitle, words))
    return [
        np.log1p(n), np.log1p(m), sizes.mean(), (sizes > 14).mean(), (sizes < 4).mean(), kinds[1], kinds[2], kinds[3], kinds[4],
        kinds[5], kinds[6], kinds[7], len(counts) / m, max(counts.values()) / m, len(set(zip(words, words[1:], strict=False))) / max(1, m - 1), len(set(lines)) / len(lines),
        np.log1p(len(lines)), m / len(lines), m / (1 + ends), capital / m, len(zlib.compress(b, 1)) / n, (kinds[3] + kinds[6] + kinds[4] + kinds[5]) * n / m,
    ]


class Gam:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, edges: list[np.ndarray], base: float, mains: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.edges, self.base, self.mains, self.pairs = edges, base, mains, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of each row, between 0 and 1."""
        b, z = self.bins(x), np.full(len(x), self.base)
        for f, t in enumerate(self.mains):
            z += t[b[:, f]]
        for (f, g), t in self.pairs.items():
            z += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-z))


def _best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """A tree on one feature: the value of each bin."""
    gain, at = _best_split(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], ridge, depth - 1), _tree(g[at:], h[at:], ridge, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree on two features, one cut by the first or second and then one by the other on each side: gain, values."""
    found = []
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _best_split(a.sum(1), b.sum(1), ridge)
        out, total = np.zeros_like(a), -(a.sum() ** 2) / (b.sum() + ridge)
        for rows in (slice(0, at), slice(at, None)):
            s, w = a[rows].sum(0), b[rows].sum(0)
            out[rows] = _tree(s, w, ridge, 1)
            total += float((out[rows][:1] * s).sum()) if len(out[rows]) else 0.0
        found.append((total, out.T if turned else out))
    return max(found, key=lambda x: x[0])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 10, rate: float = 0.1, ridge: float = 5.0) -> Gam:
    """Fit on a matrix of features and labels 0 and 1.  Rows of one label, or none, give that constant (none: 0.5)."""
    k = x.shape[1] if x.ndim == 2 else len(NAMES)
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Gam([np.zeros(0)] * k, float(np.log(share / (1 - share))), [np.zeros(1)] * k, {})
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    model = Gam(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], {})
    b, z = model.bins(x), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            size = len(edges[f]) + 1
            step = rate * _tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size), ridge)
            model.mains[f] += step
            z += step[b[:, f]]

    def cells(f: int, q: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(edges[f]) + 1, len(edges[q]) + 1
        at = b[:, f] * shape[1] + b[:, q]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_pair_tree(*cells(f, q, g, h), ridge)[0], f, q) for f, q in combinations(range(k), 2)), reverse=True)
    model.pairs = {(f, q): np.zeros((len(edges[f]) + 1, len(edges[q]) + 1)) for gain, f, q in gains[:n_pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (f, q), t in model.pairs.items():
            step = rate * _pair_tree(*cells(f, q, *slopes()), ridge)[1]
            t += step
            z += step[b[:, f], b[:, q]]
    return model


def in_training(doc_id: str) -> Column:
    """Whether a labelled row may be learned from: crc32 of the id as text, mod 3, is not 1.  A null id has no such number;
    it has no label either, and isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Gam:
    """Fit on at most so many labelled documents outside the held-out part, the first by hash of doc_id.  Rows without
    doc_id or label don't count; of labels that repeat a doc_id the largest counts."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("y")).dropna().filter(in_training("doc_id"))
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # the broadcast side has at most `most` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(extract, "doc_id long, y int, x array<double>")
    # rows that repeat a doc_id count too, but no more than `most` in all
    got = sorted((r["doc_id"], r["y"], tuple(r["x"])) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most).collect())
    return fit(np.array([r[2] for r in got]), np.array([float(r[1] > 0) for r in got]))


def _parts(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts are in memory twice."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, score for every row of docs (doc_id, text; other columns are ignored).  Null texts count as empty, which
    has a score too; texts of any length are read whole.  Rows are scored one by one, so those that repeat a doc_id or a
    text, or have a null doc_id, each have a score, the same for the same text; an empty table has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            s = shared.value.score(np.array([features(t) for t in part.column(1).to_pylist()]).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(scored), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least so high, with all their columns (whatever their names), in one pass.  Each
    row is decided on by its own text, null counting as empty; doc_ids, also null or repeated ones, play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            s = shared.value.score(np.array([features(t) for t in part.column(at).to_pylist()]).reshape(-1, len(NAMES)))
            yield part.filter(pa.array(s >= least))

    return docs.mapInArrow(tidy(kept), docs.schema)
