import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluiceway.llm import jaccard_join as J
from sluiceway.llm.components import components
from sluiceway.llm.shingles import shingle_sets

from .conftest import LOW


def brute_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, num, den):
    sets = [(d, brute_set(t, n)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr(d), len(s), repr(least.get(find(i)) if s else d)) for i, (d, s) in enumerate(sets))


def near(text, changes, seed):
    w = text.split()
    for k in range(changes):
        w[(seed * 31 + k * 17) % len(w)] = f"n{seed}k{k}"
    return " ".join(w)


@pytest.mark.parametrize("n, num, den, options", [(5, 80, 100, {}), (4, 85, 100, {"long_list": 2, "pivot_from": 2}), (2, 50, 100, {"long_list": 3, "pivot_from": 3}), (3, 95, 100, {"pivot_from": 2})])
def test_against_brute_force(frame, words, n, num, den, options):
    base, other, passage = words(120, 1), words(80, 2), words(60, 3)
    rows = [(100 + i, near(base, i % 5, i)) for i in range(30)] + [(200 + i, near(other, 1 + i % 3, i).upper()) for i in range(15)]
    rows += [(300 + i, passage + " " + words(5 + 4 * i, 50 + i)) for i in range(20)] + [(400 + i, passage) for i in range(5)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "b a"), (7, "a"), (8, words(20_000, 8)), (9, words(20_000, 8) + " x"), (10, "é " * 40), (None, base), (None, "only null here"), (11, other), (11, base)]
    got = J.jaccard_join(frame(rows), words=n, num=num, den=den, **options).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows, n, num, den)


@pytest.mark.parametrize("options", [{}, {"long_list": 3, "pivot_from": 2}])
def test_all_links_are_found(frame, words, options):
    """Also those inside a component that the pivots join already."""
    base = words(120, 1)
    rows = [(100 + i, near(base, i % 6, i)) for i in range(40)] + [(200 + i, words(60, 3) + " " + words(5 + 3 * i, 50 + i)) for i in range(12)]
    rows += [(300, base), (99, near(base, 2, 1)), (1, None), (2, "a b"), (None, near(base, 1, 77))]
    docs = frame(rows)
    sets, want = {}, set()
    for d, t in rows:
        if t:
            sets.setdefault(brute_set(t, 3), []).append(d)
    names = {s: min((d for d in ds if d is not None), default=None) for s, ds in sets.items()}
    each = list(sets)
    similar = [(a, b) for i, a in enumerate(each) for b in each[:i] if 100 * len(a & b) >= 80 * len(a | b)]
    want = sorted(repr(sorted([names[a], names[b]], key=repr)) for a, b in similar)
    got = J.jaccard_links(docs, words=3, **options).collect()
    assert sorted(repr(sorted([r.a, r.b], key=repr)) for r in got) == want and len(want) > 100
    n = {names[s]: sum(s in p for p in similar) for s in each}
    of = {d: s for s, ds in sets.items() for d in ds}
    for r in J.jaccard_join(docs, words=3, **options).collect():
        s = of.get(r.doc_id)
        assert (r.class_id, r.n_links) == ((names[s], n[names[s]]) if s else (r.doc_id, 0))


def test_lists_longer_than_their_counters_say(spark, frame, words, monkeypatch):
    """Lists are cut where they are built, whatever the counters said."""
    base = words(60, 1)
    rows = [(i, near(base, i % 4, i)) for i in range(60)] + [(100 + i, words(50, 3) + " " + words(3 + i, 50 + i)) for i in range(30)]
    monkeypatch.setattr(J, "counted", lambda described: np.zeros(J.COUNTERS, np.uint32))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = J.jaccard_join(frame(rows), words=3, num=70, den=100, long_list=2, pivot_from=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows, 3, 70, 100)


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_lists_come_whole_or_in_numbered_parts(data):
    sizes = data.draw(st.lists(st.integers(1, 9), max_size=8))
    rows = [i for i, n in enumerate(sizes) for _ in range(n)]
    cuts = sorted(data.draw(st.lists(st.integers(0, len(rows)), max_size=6)))
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[a:b], pa.int64())], names=["t"]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    most = data.draw(st.sampled_from([None, 2, 4]))
    out, last = [], (None, None)
    for batch, part in J._lists(iter(batches), ["t"], most):
        got = batch.column("t").to_pylist()
        if part:
            assert len(set(got)) == 1 and last == (got[0], part - 1)
        else:
            assert got[0] != last[0]
        last = (got[-1], part)
        out += got
    assert out == rows


def brute_keep(rows, n, num, den):
    """By row: the first of each component by (doc_id, nulls last; digest of the text); rows without words stay."""
    sets = [brute_set(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for i, (d, t) in enumerate(rows):
        if sets[i]:
            rank = (d is None, d or 0, hashlib.sha256((t or "").encode()).digest(), i)
            best[group[i]] = min(rank, best.get(group[i], rank))
    stay = {rank[-1] for rank in best.values()} | {i for i, s in enumerate(sets) if not s}
    return sorted(repr(rows[i]) for i in stay)


@pytest.mark.parametrize("options", [{}, {"long_list": 2, "pivot_from": 2}])
def test_keep_one_drops_rows_not_ids(frame, words, options):
    a, b, c = words(100, 1), words(80, 2), words(60, 3)
    rows = [(5, a), (11, a), (11, b), (11, near(b, 1, 9)), (12, near(b, 1, 9)), (None, c), (None, near(c, 1, 4)), (None, near(a, 1, 5)), (20, None), (20, ""), (20, ""), (None, None)]
    rows += [(30, c + " z"), (30, c + " z"), (31, words(70, 5)), (31, words(70, 6)), (31, words(70, 6)), (None, words(40, 8)), (None, words(40, 8))]
    docs = frame(rows)
    got = sorted(repr((r.doc_id, r.text)) for r in J.keep_one(docs, words=3, **options).collect())
    assert got == brute_keep(rows, 3, 80, 100)
    assert "(11, " + repr(b) + ")" in got or "(11, " + repr(near(b, 1, 9)) + ")" in got


def test_empty_and_keep_one(frame, words):
    assert J.jaccard_join(frame([])).collect() == []
    a = words(100)
    docs = frame([(5, a), (3, near(a, 1, 2)), (9, words(50, 4)), (7, ""), (8, None), (None, "b c")])
    out = J.keep_one(docs)
    assert out.columns == docs.columns and sorted(map(repr, (r.doc_id for r in out.collect()))) == ["3", "7", "8", "9", "None"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb \n\x1cé", max_size=40)), max_size=12), st.integers(1, 5))
def test_sets_have_the_sizes_and_equalities_of_brute_force(texts, n):
    got, want = list(shingle_sets(pa.array(texts, pa.string()), n)), [brute_set(t, n) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i, a in enumerate(got):
        for j, b in enumerate(got):
            assert len(np.intersect1d(a, b)) == len(want[i] & want[j])


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_skipping_loses_no_pair(data):
    """In a list of sets that share a shingle, every similar pair whose first common shingle this is must come."""
    num, den = data.draw(st.sampled_from([(80, 100), (50, 100), (90, 100)]))
    sets = data.draw(st.lists(st.frozensets(st.integers(1, 14), min_size=0, max_size=12), min_size=2, max_size=9))
    sets = sorted({s | {0} for s in sets}, key=lambda s: (len(s), sorted(s).index(0)))
    n = np.array([len(s) for s in sets])
    k = len(sets)
    pivot = np.zeros(k, int)
    common = np.array([len(s & sets[0]) for s in sets])
    none = np.full(k, -1)
    for know in (common, none):
        found = {}
        for i, js, sure in J.candidates(n, np.zeros(k, int), np.arange(k), none, pivot, know, np.full(k, n[0]), num, den):
            found.update({(i, int(j)): s for j, s in zip(js, sure, strict=True)})
        for i in range(k):
            for j in range(i + 1, k):
                similar = den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])
                assert not similar or (i, j) in found
                assert not found.get((i, j)) or similar


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 299), (299, 300), (159, 500), (500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in [*range(101, 160), 500, 501]}, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
