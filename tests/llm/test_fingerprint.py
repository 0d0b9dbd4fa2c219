import pytest
from pyspark.sql import functions as F

from sluiceway.llm import fingerprint as P

from .conftest import LOW


def shingles(text, n):
    w = (text or "").translate(LOW).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string")


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_next_document(spark, frame, words, range_rows):
    rows = [(i * i - 50, words(i, i)) for i in range(25)] + [(3, None), (5, "é" * 7), (5, "a"), (None, "first"), (2**62, "last one")]
    rows += [(77, words(3, i % 15)) for i in range(30)] + [(None, words(2, i)) for i in range(9)]
    h = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], h[r[1] or ""], r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((repr(d), t, t[: len(t) - h] + after[:h]))
    got = P.fingerprints(frame(rows), range_rows=range_rows).collect()
    assert sorted((repr(r.doc_id), r.text, r.edited_text) for r in got) == sorted(want)


def test_estimates_are_exact_for_small_sets_and_near_for_large(spark, words):
    cases = [("a b c d e f g", "A B\tc d e f g h"), ("", ""), ("", "a"), ("a b", "a  b"), ("a b", "b a"), (words(60), words(60) + " " + words(20, 1))]
    for a, b in cases:
        s, t = shingles(a, 5), shingles(b, 5)
        r = pair(spark, a, b).select(P.sketch(F.col("a")).alias("x"), P.sketch(F.col("b")).alias("y"))
        got = r.select(P.resemblance(r.x, r.y), P.containment(r.x, r.y), P.distinct_shingles(r.x)).first()
        assert got[0] == pytest.approx(len(s & t) / len(s | t) if s | t else 1.0)
        assert got[1] == pytest.approx(len(s & t) / len(s) if s else 1.0) and got[2] == len(s)
    a = words(3000)
    b = a[: len(a) // 2] + words(1500, 9)
    s, t = shingles(a, 5), shingles(b, 5)
    r = pair(spark, a, b).select(P.sketch(F.col("a")).alias("x"), P.sketch(F.col("b")).alias("y"))
    got = r.select(P.resemblance(r.x, r.y), P.containment(r.x, r.y), P.distinct_shingles(r.x)).first()
    assert abs(got[0] - len(s & t) / len(s | t)) < 0.12 and abs(got[1] - len(s & t) / len(s)) < 0.2 and abs(got[2] / len(s) - 1) < 0.3


def test_sketches_against_brute_force(spark, words):
    """The k least of the distinct hashes of the shingles, each hash taken from Spark word by word."""
    for text in (words(400), "A b  a B " * 30, "x", "", "é\ttwo\nthree four five six", words(5)):
        w = text.translate(LOW).replace("\t", " ").replace("\n", " ").split()
        table = spark.createDataFrame([(x,) for x in set(w)], "w string").select("w", F.xxhash64("w").alias("h")).collect()
        h = {r.w: r.h for r in table}
        runs = {tuple(h[x] for x in s) for s in shingles(text, 5)}
        if 0 < len(w) < 5:
            want = [spark.sql(f"select xxhash64({len(w)}, array({', '.join(f'{x}L' for x in next(iter(runs)))}))").first()[0]]
        else:
            want = sorted(r[0] for r in spark.createDataFrame(list(runs), "a long, b long, c long, d long, e long").select(F.xxhash64(*"abcde")).collect()) if runs else []
        got = spark.createDataFrame([(text,)], "t string").select(P.sketch(F.col("t"), 16)).first()[0]
        assert got == want[:16]


def test_parts_merge_into_the_whole(spark, words):
    a = words(400)
    w = a.split()
    parts = " ".join(w[:200]), " ".join(w[196:])  # overlapping by four words, so that no shingle is lost
    r = spark.createDataFrame([(a, *parts)], "a string, b string, c string").select(*[P.sketch(F.col(c)).alias(c) for c in "abc"])
    whole, merged = r.select("a", P.merge(r.b, r.c)).first()
    assert whole == merged


def test_equal_texts_have_equal_fingerprints_and_empty_tables_work(frame, words):
    got = P.fingerprints(frame([(1, words(50)), (2, words(50)), (3, words(50, 2))])).orderBy("doc_id").collect()
    assert got[0].sketch == got[1].sketch != got[2].sketch and got[0].near_next == 1.0 and got[1].near_next == 0.0
    one = P.fingerprints(frame([(7, "abcd")])).first()
    assert one.edited_text == "abab" and one.near_next == 1.0
    assert P.fingerprints(frame([])).collect() == []
