import hashlib

import pytest
from pyspark.sql import functions as F

from sluiceway.llm import exact_dedup as E

from .conftest import LOW


def expected(rows):
    norm = [(d, (t or "").translate(LOW)) for d, t in rows]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    return sorted((repr(d), repr(max((x for x in groups[t] if x is not None), default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)


def test_decisions(frame, words):
    long = words(40_000, 3) + ". "
    rows = [(1, "Ab c. D"), (2, "aB C. d"), (3, "ÀB"), (4, "àB"), (5, None), (6, ""), (7, long), (8, long.upper()), (9, long + "x"), (None, "q"), (11, "q"), (12, "s"), (12, "s"), (None, None), (13, "İ"), (14, "i̇")]
    got = E.exact_dedup(frame(rows)).collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for same in by.values():  # one row of each group stays, and it has the largest doc_id
        stays = [r for r in same if r.kept]
        assert len(stays) == 1 and stays[0].doc_id == stays[0].keep_id


@pytest.mark.parametrize("least, most", [(1, 4), (5, 9), (16, 64)])
def test_chunks_are_the_text_and_follow_content(spark, words, least, most):
    texts = ["", "a", "a. b. c! d?\ne", words(50), "x" * 200, ". " * 40, "é亜\u0434" * 70, "\0\x7f\x80ÿ\n" * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, c in df.select("t", E.chunks(F.col("t"), least, most)).collect():
        assert "".join(c).encode("latin-1").decode() == t and all(len(x) <= most for x in c)
    shifted = "".join(chr(97 + int(c, 16)) if c not in " w" else c for c in words(2000)).replace("w", "").replace("k", "s")
    a, b = (spark.createDataFrame([(t,)], "t string").select(E.chunks(F.col("t"), 20, 4000)).first()[0] for t in (shifted, "new start. " + shifted))
    assert len(a) > 20 and len(set(a) & set(b)) > 0.8 * len(a)  # cuts meet again after an insertion


@pytest.mark.parametrize("first, last", [(0x4E00, 0x9FA5), (0x430, 0x44F), (0xAC00, 0xD7A3), (0x621, 0x64A)])
def test_cuts_follow_content_in_scripts_without_spaces(spark, words, first, last):
    text = "".join(chr(first + int(c, 16) * int(d, 16) * 7919 % (last - first)) for w in words(4000).split() for c, d in zip(w[1:], w[2:]))
    a, b = (spark.createDataFrame([(t,)], "t string").select(E.chunks(F.col("t"))).first()[0] for t in (text, text[1500:1700] + text))
    assert len(a) > 10 and len(set(a) & set(b)) > 0.7 * len(a)


def test_small_chunks_give_the_same_groups(frame, words):
    rows = [(i, words(30, i % 4).replace(" ", ". ")) for i in range(20)] + [(50, "a. b. "), (51, "b. a. ")]
    a, b = (sorted(map(tuple, E.exact_dedup(frame(rows), *size).collect())) for size in ((3, 12), (1024, 4096)))
    assert a == b


def test_keep_first(frame):
    rows = [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (4, None), (5, ""), (None, "z"), (6, "z")]
    docs = frame(rows)
    out = E.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(2, "A"), (3, "b"), (5, ""), (6, "z")]


def test_empty(frame):
    assert E.exact_dedup(frame([])).collect() == [] and E.keep_first(frame([])).collect() == []
