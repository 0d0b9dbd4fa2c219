import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluiceway.llm import pii as P

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        twice = [x * 2 if i % 2 else x for i, x in enumerate(d[::-1])]
        return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if passes(kind, m[0])]
    return sorted(found)


CARD = "4111111111111111"
TEXTS = [
    None, "", "no data at all", "mail a.b+c@x-y.example.com, and a@b", "ip 10.0.0.1 and 256.1.1.1 or 1.2.3.4.5.6.7.8 or 0000.00.0.255", f"card {CARD} 4111 1111 1111 1111 4111-1111-1111-1112", f"{CARD} {CARD}",
    "+1 (743) 555-3824 and +12 and +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 (743) 555-3824 é " * 30, "9" * 3000, "1.1.1.1" * 50, "@" * 100, f"é{CARD}é a@b.c", "x" * 50_000 + " a@b.cd",
]


def test_base_spans():
    for t in TEXTS:
        assert P.base_spans(t or "") == brute(t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@aé4", max_size=60))
def test_base_spans_of_any_text(t):
    assert P.base_spans(t) == brute(t)


def test_operator(frame, spark):
    rows = list(enumerate(TEXTS)) + [(None, CARD), (3, TEXTS[3])]
    docs = frame(rows)
    got = P.pii_spans(docs).collect()
    told = lambda spans: [(s.start, [k for k, _ in PATTERNS].index(s.kind), s.end) for s in spans]
    texts = {(repr(d), repr(told_)) for d, told_ in ((d, brute(t or "")) for d, t in rows)}
    assert {(repr(r.doc_id), repr(told(r.base))) for r in got} == texts and len(got) == len(rows)
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)
    assert P.pii_spans(frame([])).collect() == []


def weights(docs=120):
    """Fitted on documents of the common forms, some with a number or an address twice."""
    rows = []
    for i in range(docs):
        t = f"call +1 ({300 + i}) 555-{1000 + i} or write n{i}@mail.example.com from 10.{i}.0.7 with {CARD} in {1900 + i}, item {i} of 10{i}44 and order 77{i}1234"
        if i % 3 == 0:
            t += f" - again +1 ({300 + i}) 555-{1000 + i} or n{i}@mail.example.com and order 77{i}1234"
        rows += P.examples(t)
    z, k = np.array(rows), len(P.FEATURES)
    return P.fit(z[:, :k], z[:, k : k + P.LABELS], z[:, k + P.LABELS : -1], z[:, -1].astype(int))


def test_the_field_adds_what_patterns_miss_and_leaves_plain_numbers():
    (base, spans), (_, clean) = P.find([f"pay with {CARD} {CARD} today", "in 1999 we sold 12 of 345 items, 0.5 of 7, order 4477889 twice: 4477889"], weights())
    assert base == [] and [(s, P.KINDS[k], e) for s, k, e in spans] == [(9, "card", 25), (26, "card", 42)]
    assert clean == []


@pytest.mark.parametrize("far", [1, 400])
@pytest.mark.parametrize("full, again, kind", [("+44 20 7946 0958", "020 7946 0958", 3), ("+1 (743) 555-3824", "743-555-3824", 3), ("jo.smith@mail.example.com", "Jo.Smith@mail", 0)])
def test_only_the_skip_link_adds_the_span(full, again, kind, far):
    """Alone, or beside another number, the second form stays; with its like anywhere in the document it is found.  Without
    the weights of skip links it isn't."""
    w, gap = weights(), " and so on" * far
    texts = [f"reach {again} now", f"reach {full}{gap} or again {again} now", f"reach +1 (999) 123-4567 or k@other.example.com{gap} or again {again} now"]
    alone, both, other = P.find(texts, w)
    start = texts[1].rindex(again)
    assert set(both[1]) - set(both[0]) == {(start, kind, start + len(again))}
    assert alone == ([], []) and other[1] == other[0] and len(other[0]) == 2
    for base, spans in P.find(texts, (w[0], w[1], 0 * w[2])):
        assert base == spans


def test_all_copies_are_linked():
    w = weights()
    for copies in (3, 11, 12, 40):  # in groups by pairs and in larger ones
        text = "reach +44 20 7946 0958 now" + "".join(f" and item number {i} or 020 7946 0958 too" for i in range(copies))
        (base, spans), = P.find([text], w)
        assert len(base) == 1 and len(spans) == 1 + copies


def exact(node, factors):
    """Marginals by enumeration; factors: (i, j, potentials)."""
    out = np.zeros(node.shape)
    for y in itertools.product(range(node.shape[1]), repeat=len(node)):
        v = np.exp(sum(node[i, k] for i, k in enumerate(y)) + sum(f[y[i], y[j]] for i, j, f in factors))
        for i, k in enumerate(y):
            out[i, k] += v
    return out / out.sum(1, keepdims=True)


def factors_of(chain, groups, w):
    return [(a, b, w[1]) for a, b in chain] + [(a, b, w[2] / (len(g) - 1)) for g in groups for k, a in enumerate(g) for b in g[k + 1 :]]


@pytest.mark.parametrize("chain, groups", [([], []), ([(0, 1), (1, 2), (2, 3)], []), ([(0, 1), (2, 3)], [[1, 2]]), ([(0, 1)], [[0, 2], [1, 3]])])
def test_beliefs_are_exact_on_trees(chain, groups):
    rng = np.random.default_rng(5)
    for _ in range(5):
        a, b = (x + x.T for x in rng.normal(size=(2, P.LABELS, P.LABELS)))
        node, w = rng.normal(size=(4, P.LABELS)) * 2, (None, a, b)
        assert np.allclose(P.beliefs(node, chain, groups, w), exact(node, factors_of(chain, groups, w)), atol=1e-5)


@pytest.mark.parametrize("chain, groups", [([(0, 1), (1, 2)], [[0, 2]]), ([], [[0, 1, 2, 3]]), ([(0, 1), (1, 2), (2, 3)], [[0, 3], [1, 2]])])
@pytest.mark.parametrize("most", [12, 1])
def test_beliefs_are_near_on_loops(chain, groups, most, monkeypatch):
    monkeypatch.setattr(P, "PAIRWISE", most)
    rng = np.random.default_rng(6)
    w = (None, 0.3 * np.eye(P.LABELS), 0.9 * np.eye(P.LABELS))
    for _ in range(5):
        node = rng.normal(size=(4, P.LABELS)) * 2
        assert np.abs(P.beliefs(node, chain, groups, w) - exact(node, factors_of(chain, groups, w))).max() < (0.03 if most > 1 else 0.15)


@pytest.mark.parametrize("text", ["x" * 1_000_000, "x" * 500_000 + "1" + "y" * 500_000, "7" * 1_000_000, "1.2." * 250_000, "a@" * 500_000, "+1(" * 300_000, "1 2-3." * 150_000, "1234 " * 200_000, "1-" * 400_000 + "@x"])
def test_long_texts_without_spaces_take_linear_time(text):
    began = time.perf_counter()
    P.find([text], WEIGHTS)
    assert time.perf_counter() - began < 30


WEIGHTS = weights()


def test_redaction(frame):
    docs = frame([(1, "mail a@b.cd now"), (2, None), (3, "clean"), (4, ""), (1, "mail a@b.cd now"), (None, "mail a@b.cd now"), (5, "z" * 100_000 + " a@b.cd")])
    out = {r.doc_id: r for r in P.redact(docs).collect()}
    assert out[1].text == out[None].text == "mail [EMAIL] now" and out[1].n_chars == len(out[1].text) and out[5].text == "z" * 100_000 + " [EMAIL]"
    assert (out[2].text, out[3].text, out[4].text, out[3].n_chars, out[1].kept) == (None, "clean", "", 5, "kept")
    assert P.redact(docs).columns == docs.columns and P.redact(docs).count() == 7
    assert P.redact(frame([])).collect() == []
