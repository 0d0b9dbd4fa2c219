"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find the base spans.  The field then labels the tokens of a document (runs of digits, and words with an @):
neighbours are linked in a chain, and all tokens that repeat or resemble each other are linked over any distance.  Loopy
message passing makes the labels agree, so that a number told apart in one place is also found where the pattern alone fails.

All weights are fitted to base spans.  Tokens with a twin come twice, once without what their own form tells, so that the
weights of skip links learn how much a twin's label says about such a token.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, tidy

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans, in forms that take linear time: an address is looked for from its @, and parts of
#: numbers aren't tried again.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
#: Digits with signs between them, each run as long as can be; and its parts without a space.
RUN = re.compile(r"[(+]{0,2}[0-9]++(?:(?:[).]?[\x20-][(]?|[./()-])[0-9]++)*+")
PART = re.compile(r"[0-9]++(?:-[0-9]++)*+")
FOURS = re.compile(r"(?<![0-9])[0-9]{4}(?:\x20[0-9]{4}){3}(?![0-9])")
HOST = re.compile(r"[A-Za-z0-9.-]*")
#: The field is fitted on the tokens of at most so many documents, the first by hash of doc_id, and so many of each.
MAX_TRAIN, MAX_TOKENS = 4000, 50
#: A label other than "none" needs this much belief.
BELIEF = 0.9
ROUNDS, DAMPING = 30, 0.3
#: What two linked tokens gain by equal labels, before the sample says otherwise.
AGREE = 2.0
#: Groups of more alike tokens than this pass on beliefs, not a message for each pair.
PAIRWISE = 12
#: Neighbours in the chain are at most so many code points apart; tokens handled at once, but for those of one text.
NEAR, AT_ONCE = 40, 20_000

LABELS = len(KINDS) + 1
FEATURES = (
    "one", "mail", "at", "ip", "four", "card", "long", "plus", "bracket", "dash", "dot", "space",
    "n<7", "n<10", "n<14", "n<20", "more", "glued", "sign", "near",
)
#: What a token's own form tells.
FORM = np.array([f in ("mail", "ip", "four", "card", "plus", "bracket", "dash", "dot", "space") for f in FEATURES])


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the addresses: for each @ all the letters before it that may stand there, and a domain after it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = at = m.end() if m else at + 1
        if m:
            yield start, m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kind is the place in KINDS."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _ip(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """The tokens of a text in order: runs of at least four digits, cut at spaces (but for four groups of four) where they
    have more than a number can, and what stands around an @."""
    out, done, at = [], 0, 0
    while (at := text.find("@", at)) >= 0:
        start, end = done + len(text[done:at].rstrip(LOCAL)), HOST.match(text, at + 1).end()
        if start < at and end > at + 1:
            out.append((start, end))
        done = at = max(end, at + 1)
    mails, k = list(out), 0
    for m in RUN.finditer(text):
        while k < len(mails) and mails[k][1] <= m.start():
            k += 1
        if k < len(mails) and mails[k][0] < m.end():
            continue
        n = len(_digits(m[0]))
        if n > 15:
            fours = [x.span() for x in FOURS.finditer(text, m.start(), m.end())]
            parts = [x.span() for x in PART.finditer(text, m.start(), m.end())]
            j = 0
            for a, b in parts:
                while j < len(fours) and fours[j][1] <= a:
                    j += 1
                if len(_digits(text[a:b])) >= 4 and not (j < len(fours) and fours[j][0] < b):
                    out.append((a, b))
            out += fours
        elif n >= 4:
            out.append(m.span())
    return sorted(out)


class Tokens:
    """The tokens of some documents, their features and links."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.x: list[list[float]] = []
        self.base: list[int] = []  # 0: none, else kind + 1
        self.valid: list[tuple] = []
        self.chain: list[tuple[int, int]] = []
        self.groups: list[list[int]] = []  # two or more alike tokens of one document

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        """A document's tokens.  One is linked with the one before it if that is near; all with one key are a group: the
        letters before an @, the last seven digits, or all where they are fewer."""
        alike: dict[str, list[int]] = {}
        before, at = None, 0
        for start, end in tokens(text):
            word, i = text[start:end], len(self.spans)
            while at < len(base) and base[at][2] <= start:
                at += 1
            kind = next((k + 1 for s, k, e in base[at : at + 4] if s < end and start < e), 0)
            mail, d = "@" in word, _digits(word)
            n, dots = len(d), word.count(".")
            ip = IP.fullmatch(word) is not None and _ip(word)
            card = 14 <= n <= 19 and not mail and not word.strip("0123456789- ") and luhn(d)
            last, first = text[start - 1 : start], text[end : end + 1]
            glued = not mail and (last.isalnum() or last == "_" or first.isalnum() or first == "_")
            near = before is not None and start - self.spans[before][2] <= NEAR
            self.spans.append((doc, start, end))
            self.base.append(kind)
            self.valid.append((mail, ip, card, 7 <= n <= 15 and not mail and not glued and not ip))
            self.x.append([
                1, mail and DOMAIN.fullmatch(word, word.index("@") + 1) is not None, mail, ip, dots == 3 and not ip and not mail, card, 14 <= n <= 19 and not mail, "+" in word[:2] and not mail,
                "(" in word, not mail and "-" in word, not mail and 0 < dots < 3, " " in word, n < 7 and not mail, 7 <= n < 10 and not mail, 10 <= n < 14 and not mail, 14 <= n < 20 and not mail,
                n >= 20 and not mail, glued, last != "" and last in "#$%&=/", near,
            ])
            if near:
                self.chain.append((before, i))
            alike.setdefault(word.split("@")[0].lower() + "@" if mail else d[-7:], []).append(i)
            before = i
        self.groups += [g for g in alike.values() if len(g) > 1]

    def open(self) -> bool:
        """Whether any token could be added."""
        return any(not k and any(v) for k, v in zip(self.base, self.valid, strict=True))


Weights = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(x: np.ndarray, chain: np.ndarray, skip: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Weights:
    """Weights by maximum pseudo-likelihood: of the features, of a chain link and of the skip links.  chain: how many of a
    token's neighbours have each label; skip: which share of the tokens alike, see shares.  Rows with a share come a second time without
    the features of FORM.  Weights are drawn to 0, those of skip links to agreement.  Without tokens the others are 0."""
    k = len(FEATURES)
    prior = np.zeros((k + 2 * LABELS, LABELS))
    prior[k + LABELS :] = AGREE * np.eye(LABELS)
    w = prior.copy()
    if len(y):
        twin = skip.sum(1) > 0
        z = np.concatenate([np.concatenate([x, chain, skip], 1), np.concatenate([x[twin] * ~FORM, chain[twin], skip[twin]], 1)])
        goal = np.eye(LABELS)[np.concatenate([y, y[twin]])]
        speed = np.zeros_like(w)
        for _ in range(steps):
            s = z @ w
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed + z.T @ (goal - p) / len(z) - ridge * (w - prior)
            w += rate * speed
    a, b = w[k : k + LABELS], w[k + LABELS :]
    return w[:k], (a + a.T) / 2, (b + b.T) / 2


def _passed(about: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """The message of each row of log beliefs about its sender's label, over a link with potentials psi (by row or for all)."""
    out = about[:, :, None] + psi
    top = out.max(1, keepdims=True)
    new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
    return new - new.max(1, keepdims=True)


def beliefs(node: np.ndarray, chain: list[tuple[int, int]], groups: list[list[int]], weights: Weights) -> np.ndarray:
    """The belief in each label of each token after loopy message passing, from the log potentials of the tokens.  Two tokens
    of a group of k share the potential of a skip link, 1 / (k - 1) of it; so all of a group speak to each other.  In a group
    of more than PAIRWISE, where what one token has said hardly counts, each tells all others its belief."""
    links, scale = list(chain), [1.0] * len(chain)
    large = [np.array(g) for g in groups if len(g) > PAIRWISE]
    for g in groups:
        if len(g) <= PAIRWISE:
            new = [(a, b) for i, a in enumerate(g) for b in g[i + 1 :]]
            links += new
            scale += [1 / (len(g) - 1)] * len(new)
    k = len(links)
    a, b = np.array(links, int).reshape(-1, 2).T
    src, dst, back = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([np.arange(k, 2 * k), np.arange(k)])
    psi = np.concatenate([np.broadcast_to(weights[1], (len(chain), LABELS, LABELS)), np.array(scale[len(chain) :]).reshape(-1, 1, 1) * weights[2]])
    psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
    m, said = np.zeros((2 * k, LABELS)), [np.zeros((len(g), LABELS)) for g in large]
    still = False
    for turn in range(ROUNDS + 1):
        total = node.astype(float)
        np.add.at(total, dst, m)
        for g, s in zip(large, said, strict=True):
            total[g] += s.sum(0) - s
        if still or turn == ROUNDS:
            break
        old = m
        m = DAMPING * m + (1 - DAMPING) * _passed(total[src] - m[back], psi)
        said = [DAMPING * s + (1 - DAMPING) * _passed(total[g], weights[2] / (len(g) - 1)) for g, s in zip(large, said, strict=True)]
        still = not large and (not k or float(np.abs(m - old).max()) < 1e-7)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def shares(t: Tokens) -> np.ndarray:
    """For each token which share of those alike has each label: of those in base spans, or where none is, of all."""
    out = np.zeros((len(t.spans), LABELS))
    for g in t.groups:
        have = np.eye(LABELS)[[t.base[i] for i in g]]
        known = have * (np.arange(LABELS) > 0)
        others, sure = have.sum(0) - have, known.sum(0) - known
        pick = np.where(sure.any(1, keepdims=True), sure, others)
        out[g] = pick / pick.sum(1, keepdims=True)
    return out


def _potentials(t: Tokens, weights: Weights) -> tuple[np.ndarray, list[list[int]]]:
    """The log potentials of all tokens, and the groups still to agree.  Tokens in base spans hold to their labels; what
    they say to those alike is fixed by that, however many there are, and the rest of a group agrees among itself."""
    node, known = np.array(t.x, float).reshape(-1, len(FEATURES)) @ weights[0], np.array(t.base, int)
    told = shares(t)
    told[~told[:, 1:].any(1)] = 0
    node += told @ weights[2]
    node[known > 0] = -20.0
    node[known > 0, known[known > 0]] = 0.0
    rest = [[i for i in g if not t.base[i]] for g in t.groups]
    return node, [g for g in rest if len(g) > 1]


def _added(t: Tokens, weights: Weights) -> list[tuple[int, tuple[int, int, int]]]:
    """Document and span of each token outside all base spans that the field gives a kind it has the form of."""
    if not t.open():
        return []
    node, groups = _potentials(t, weights)
    p = beliefs(node, t.chain, groups, weights)
    label = p.argmax(1)
    sure = np.flatnonzero((np.array(t.base) == 0) & (label > 0) & (p.max(1) >= BELIEF)).tolist()
    return [(t.spans[i][0], (t.spans[i][1], int(label[i]) - 1, t.spans[i][2])) for i in sure if t.valid[i][int(label[i]) - 1]]


def find(texts: list[str | None], weights: Weights) -> list[tuple[list, list]]:
    """Of each text (null: empty) the base spans and all spans, sorted, as (start, kind, end).  A span is added for a token
    outside all base spans that the field gives a kind it has the form of."""
    out, t = [], Tokens()

    def settle() -> None:
        nonlocal t
        for doc, span in _added(t, weights):
            out[doc][1].append(span)
        t = Tokens()

    for i, text in enumerate(texts):
        some = text and ("@" in text or DIGIT.search(text))
        base = base_spans(text) if some else []
        out.append((base, list(base)))
        if some:
            t.add(i, text, base)
            if len(t.spans) > AT_ONCE:
                settle()
    settle()
    for _, spans in out:
        spans.sort()
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def examples(text: str) -> list[list[float]]:
    """Rows to fit on: features, labels of neighbours, shares of the labels of tokens alike, label.  Tokens that look like
    their twin in a base span and aren't in one tell nothing, as that is what the field is to decide."""
    t = Tokens()
    t.add(0, text, base_spans(text))
    chain, skip = np.zeros((len(t.spans), LABELS)), shares(t)
    for i, j in t.chain:
        chain[i, t.base[j]] += 1
        chain[j, t.base[i]] += 1
    told = [i for i, y in enumerate(t.base) if y or not any(t.valid[i]) or not skip[i, 1:].any()]
    told = sorted(told, key=lambda i: (zlib.crc32(f"{t.spans[i][1]}:{t.x[i]}".encode()), i))[:MAX_TOKENS]
    return [[float(v) for v in t.x[i]] + list(chain[i]) + list(skip[i]) + [float(t.base[i])] for i in told]


def train(docs: DataFrame, most: int = MAX_TRAIN) -> Weights:
    """Fit the field to the base spans of at most so many documents, and at most MAX_TOKENS tokens of each, by hash."""
    chosen = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = examples(t) if t and ("@" in t or DIGIT.search(t)) else []
                ids += [i] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "z"])

    # the broadcast side has at most `most` ids; at most `most` times MAX_TOKENS short rows come back, also where ids repeat
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(extract, "doc_id long, z array<double>")
    got = sorted(tuple(r["z"]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "z").limit(most * MAX_TOKENS).collect())
    k = len(FEATURES)
    z = np.array(got).reshape(-1, k + 2 * LABELS + 1)
    return fit(z[:, :k], z[:, k : k + LABELS], z[:, k + LABELS : -1], z[:, -1].astype(int))


def pii_spans(docs: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, base and spans (lists of kind, start, end; ends exclusive, in code points) for every row of docs (doc_id,
    text; other columns are ignored).  Null texts are empty.  Rows are handled one by one, so repeated rows give
    repeated results."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, most))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    told = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = find(part.column(1).to_pylist(), weights.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([told(b) for b, _ in found], kind), pa.array([told(a) for _, a in found], kind)], names=["doc_id", "base", "spans"])

    item = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(tidy(spans), f"doc_id long, base {item}, spans {item}")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or group of spans that overlap, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].translate(str.maketrans(UPPER.lower(), UPPER))}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """docs with the spans in text replaced; n_chars, where there is one, follows.  A null or empty text stays as it is; texts
    of any length are read whole; rows are handled one by one, so rows that repeat a doc_id or a text, or have a null doc_id,
    are replaced alike, and an empty table stays empty.  Other columns aren't touched, whatever their names."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, most))
    at, names = docs.columns.index("text"), docs.columns

    def cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(at).to_pylist()
                found = find(texts, weights.value)
                new = [t if t is None or not spans else redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    old = columns[k].to_pylist()
                    columns[k] = pa.array([o if n is t or n is None else len(n) for o, n, t in zip(old, new, texts, strict=True)], part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidy(cleaned), docs.schema)
