"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A classifier says of each block by its text, the elements around it and their hints (class,
id, role) what it costs to call it content or boilerplate: these are its capacities to the source and the sink.  Blocks that
follow each other, and blocks under one parent, are joined by smoothness edges.  The minimum cut labels the blocks.

All costs are learned from a sample of the pages: blocks that elements such as article and nav place without doubt are the
first labels, blocks that the classifier is sure of join them, and how often neighbours agree gives the edges.  Half of the
examples have their elements hidden, so that texts and hints learn to do without.  Weights start from those given below.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z|(?=<))|<[!?/][^>]*(?:>|\Z)", re.S)
HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br",
    "math", "mfrac", "mi", "mn", "mo", "mover", "mrow", "msqrt", "msub", "msubsup", "msup", "mtext", "munder",
}
#: Elements whose text is a control or markup, not text of the page.
NEVER = {"head", "select", "option", "button", "svg", "canvas", "audio", "video", "datalist", "dialog"}
BAD, GOOD = ("nav", "footer", "aside", "form", "menu", "fieldset"), {"article", "main"}
#: Elements whose parent is what their text belongs to.
LEAVES = {"p", "li", "ul", "ol", "dl", "td", "th", "tr", "tbody", "table", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption"}
#: A start tag that ends an open element of such a kind; of these and the lists and tables the nearest one counts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {*ENDS, "ul", "ol", "table", "dl", "select"}

#: Words in class, id and role that mark boilerplate: in any name, and as a whole name only.
STRONG = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "cookie", "cookies", "consent", "advert", "adverts", "advertisement",
    "sponsored", "promo", "newsletter", "subscribe", "comment", "comments", "disqus", "pagination", "pager", "toolbar", "contentinfo", "complementary",
}
WEAK = {
    "header", "masthead", "banner", "aside", "ad", "ads", "notice", "alert", "popup", "modal", "overlay", "signup", "login", "search", "share", "sharing", "social",
    "related", "recommended", "widget", "replies", "respond", "copyright", "legal", "form",
}
#: Weights before the sample says otherwise.
TEXT = {"one": -1.0, "words": 0.5, "linked": -2.0, "marks": 0.5, "ended": 0.5, "item": -0.5, "heading": 0.5}
INSIDE, BY_TAG, AROUND, NAMED, PART = 4.0, -5.0, -3.0, -4.0, -1.5
EDGES = (0.6, 1.2)

#: Hints of so many elements around a block count, the nearest ones.
NEAREST = 8
#: The costs are fitted on at most so many pages, so many blocks of each, and so many hints.
MAX_TRAIN, MAX_BLOCKS, MAX_HINTS = 500, 50, 200


class Block:
    """text; parent, a number for the element that it belongs to; never; text features; signs, the names of others."""

    __slots__ = ("text", "parent", "never", "own", "tags", "hints", "label")

    def __init__(self, text: str, linked: int, tag: str, parent: int, never: bool, tags: list[str], hints: list[str], label: int):
        self.text, self.parent, self.never, self.tags, self.hints, self.label = text, parent, never, tags, hints, label
        words = text.count(" ") + 1
        self.own = [1.0, min(float(np.log1p(words)), 6.0), linked / len(text), min(sum(map(text.count, ".!?,;")) / words, 1.0), float(text[-1] in ".!?:\"'"), float(tag == "li"), float(tag[0] == "h")]


def names_of(attributes: str) -> list[str]:
    """The names in class, id and role, lower-cased."""
    return [x for h in HINT.findall(attributes) for x in h.strip("\"'").lower().split()]


def parts_of(name: str) -> list[str]:
    found = re.findall("[a-z]+", name)
    return found if found != [name] else []


def prior(sign: str) -> float:
    """The weight of a sign before the sample says otherwise.  i, o: inside the outermost article or main or the page
    without one, or around it."""
    kind, _, name = sign.partition(":")
    if kind == "good":
        return INSIDE
    if kind == "tag":
        return BY_TAG
    if kind == "around":
        return AROUND if name not in ("form", "fieldset") else -0.5
    share = 1.0 if kind[0] == "i" else AROUND / NAMED if kind == "o" or name in STRONG else 0.2
    if name in STRONG or name in WEAK and len(kind) == 1:
        return NAMED * share
    return PART * share if name in WEAK else 0.0


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in order, white space in each turned into one space, in time linear in the page."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements: name, number of its block parent, nearest of SCOPES, nearest not inline
    hinted: list[tuple[int, list[str]]] = []  # place in the stack, names
    count: Counter[str] = Counter()
    base: tuple[int, dict[str, int]] | None = None  # outermost article or main: its place, and what is open around it
    never = number = at = linked = 0
    size, words = len(page), []

    def flush() -> None:
        nonlocal words, linked
        text = " ".join("".join(words).split())
        if text:
            block = stack[-1][3] if stack else -1
            inside = base[0] if base else -1
            tags, hints, doubt = [], [], False
            for x in BAD:
                around = base[1][x] if base else 0
                if around:
                    tags.append(f"around:{x}")
                if count[x] > around:
                    tags.append(f"tag:{x}")
            if count["header"] and not base:
                tags.append("tag:header")
            bad = any(t[0] == "t" for t in tags)
            for place, names in hinted[-NEAREST:]:
                kind = "i" if place >= inside else "o"
                for name in names:
                    hints.append(f"{kind}:{name}")
                    hints += [f"{kind}p:{x}" for x in parts_of(name)]
                    doubt = doubt or kind == "i" and (name in WEAK or name in STRONG or any(x in STRONG for x in parts_of(name)))
            if base and not bad and not doubt:
                tags.append("good:")
            label = 0 if bad else -1 if doubt or not base or any(t[0] == "a" and t[7:] not in ("form", "fieldset") for t in tags) else 1
            out.append(Block(text, min(linked, len(text)), stack[block][0] if block >= 0 else "body", stack[-1][1] if stack else 0, never > 0, tags, list(dict.fromkeys(hints)), label))
        words, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if count["a"]:
                linked += len(" ".join(text.split()))

    def push(name: str, attributes: str) -> None:
        nonlocal number, base, never
        here = len(stack)
        parent, scope, block = stack[-1][1:] if stack else (0, -1, -1)
        if name not in INLINE:
            block = here
            if name not in LEAVES:
                number += 1
                parent = number
        if name in GOOD and base is None:
            base = here, {x: count[x] for x in BAD}
        stack.append((name, parent, here if name in SCOPES else scope, block))
        count[name] += 1
        never += name in NEVER
        if name not in ("html", "body") and "=" in attributes and (names := names_of(attributes)):
            hinted.append((here, names))

    def pop() -> str:
        nonlocal base, never
        name = stack.pop()[0]
        count[name] -= 1
        never -= name in NEVER
        if base and base[0] == len(stack):
            base = None
        if hinted and hinted[-1][0] == len(stack):
            hinted.pop()
        return name

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            if count[name]:
                while pop() != name:
                    pass
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            flush()
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                words.append(" ")
            continue
        if name not in INLINE:
            flush()
            while count["p"]:
                pop()
            if name in ENDS:
                scope, end = stack[-1][2] if stack else -1, -1
                while scope >= 0 and stack[scope][0] in ENDS[name]:
                    end, scope = scope, stack[scope - 1][2] if scope else -1
                while 0 <= end < len(stack):
                    pop()
        if not m[3].rstrip().endswith("/"):
            push(name, m[3])
    flush()
    return out


def cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut, by shortest augmenting paths in levels.  edges: both ways."""
    n = len(to_source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        through = min(to_source[i], to_sink[i])  # flows at once
        if to_source[i] > through:
            join(s, i, to_source[i] - through, 0.0)
        if to_sink[i] > through:
            join(i, t, to_sink[i] - through, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt, path = [0] * (n + 2), []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(head[a]):
                path.append(head[a][nxt[a]])
                a = to[path[-1]]
            elif not path:
                break
            else:
                a = to[path.pop() ^ 1]
                nxt[a] += 1


class Costs:
    """What the sample taught: weights by text feature and by sign, and those of the edges (adjacent; under one parent)."""

    def __init__(self, text: np.ndarray, signs: dict[str, float], edges: tuple[float, float] = EDGES):
        self.text, self.signs, self.edges = text, signs, edges

    def odds(self, b: Block) -> float:
        """The log-odds of content."""
        signs = self.signs
        return float(np.dot(b.own, self.text)) + sum(signs[s] if s in signs else prior(s) for s in (*b.tags, *b.hints))


def network(found: list[Block], costs: Costs) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The log-odds of each block and the smoothness edges."""
    adjacent, sibling = costs.edges
    edges = [(i, i + 1, adjacent) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last:
            edges.append((last[b.parent], i, sibling))
        last[b.parent] = i
    return [costs.odds(b) for b in found], edges


def main_text(page: str | None, costs: Costs) -> str:
    """The blocks of a page that the cut labels content, joined by newlines."""
    found = [b for b in blocks(page or "") if not b.never]
    odds, edges = network(found, costs)
    keep = cut([max(0.0, o) for o in odds], [max(0.0, -o) for o in odds], edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def fit(own: np.ndarray, tags: list[list[str]], hints: list[list[str]], label: np.ndarray, agree: np.ndarray, steps: int = 150, rate: float = 0.5, ridge: float = 1e-3, turns: int = 2) -> Costs:
    """Logistic regression, its weights drawn to the prior ones.  label: 1, 0, or -1 for blocks that join when the classifier
    is sure of them.  agree: of neighbours, adjacent or under one parent, how many have one label and how many have two."""
    edges = tuple(float(np.clip(0.5 * np.log((same + 1) / (other + 1)), 0.1, 2.0)) if same + other else old for (same, other), old in zip(agree, EDGES, strict=True))
    known = Counter(s for h in hints for s in h)
    names = sorted({s for t in tags for s in t}) + [s for s, n in sorted(known.items(), key=lambda x: (-x[1], x[0]))[:MAX_HINTS] if n > 4]
    start = np.array([*TEXT.values(), *map(prior, names)])
    place, k = {s: i for i, s in enumerate(names)}, len(TEXT)
    x = np.zeros((len(label), len(start)), np.float32)
    rest = np.zeros(len(label))  # of hints that too few blocks have
    x[:, :k] = own.reshape(-1, k)
    for i, signs in enumerate(zip(tags, hints, strict=True)):
        for s in (*signs[0], *signs[1]):
            if s in place:
                x[i, k + place[s]] = 1
            else:
                rest[i] += prior(s)
    hidden = x.copy()  # the same blocks without their elements
    for s in names:
        if s[0] in "gat":
            hidden[:, k + place[s]] = 0
    w = start.copy()
    for turn in range(turns):
        y = label.astype(float)
        if turn:
            z = x @ w + rest
            y = np.where((y < 0) & (z > 3), 1.0, np.where((y < 0) & (z < -3), 0.0, y))
        at = np.flatnonzero(y >= 0)
        y = y[at]
        if not 0 < y.sum() < len(y):
            break
        weight = np.where(y > 0, 0.25 / y.sum(), 0.25 / (len(y) - y.sum()))
        for _ in range(steps):
            slope = sum(v.T @ (weight * (y - 1 / (1 + np.exp(-np.clip(v @ w + rest[at], -30, 30))))) for v in (x[at], hidden[at]))
            w = w + rate * (slope - ridge * (w - start))
    return Costs(w[:k], dict(zip(names, w[k:].tolist(), strict=True)), edges)


def train(pages: DataFrame, most: int = MAX_TRAIN) -> Costs:
    """Fit on at most so many pages, the first by hash, and MAX_BLOCKS blocks of each, by hash of their text."""
    mark = F.xxhash64("html")
    ids = pages.select("page_id", mark.alias("mark")).dropna().distinct().orderBy(F.xxhash64("page_id", "mark"), "page_id", "mark").limit(most)
    chosen = ids.select(F.col("page_id").alias("\x01id"), F.col("mark").alias("\x01mark"))

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                found = [b for b in blocks(p or "") if not b.never]
                agree = [0.0] * 4
                for a, b in zip(found, found[1:], strict=False):
                    if a.label >= 0 and b.label >= 0:
                        agree[2 * (a.parent == b.parent) + (a.label != b.label)] += 1
                rows.append((agree, [], [], -2))
                rows += [(b.own, b.tags, b.hints, b.label) for b in sorted(found, key=lambda b: (zlib.crc32(b.text.encode("utf-8", "surrogatepass")), b.text))[:MAX_BLOCKS]]
            names = pa.list_(pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.list_(pa.float64()), names, names, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "tags", "hints", "label"])

    # the broadcast side has at most `most` rows of two numbers; rows that repeat a page count once, so at most MAX_BLOCKS + 1 rows by page come back
    rows = pages.select("page_id", "html").join(F.broadcast(chosen), (F.col("page_id") == F.col("\x01id")) & (mark == F.col("\x01mark")), "left_semi")
    rows = rows.select("html").mapInArrow(told, "own array<double>, tags array<string>, hints array<string>, label int").distinct()
    got = sorted((tuple(r["own"]), tuple(r["tags"]), tuple(r["hints"]), r["label"]) for r in rows.collect())
    agree = np.array([r[0] for r in got if r[3] == -2]).reshape(-1, 2, 2).sum(0)
    got = [r for r in got if r[3] > -2]
    return fit(np.array([r[0] for r in got]), [list(r[1]) for r in got], [list(r[2]) for r in got], np.array([r[3] for r in got], int), agree)


def extract(pages: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """page_id, url, text for every row of pages (page_id, url, html; other columns are ignored).  A null or empty html,
    and a page without content, give an empty text; rows are handled one by one."""
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, most))

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [main_text(p, shared.value) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(texts), "page_id long, url string, text string")
