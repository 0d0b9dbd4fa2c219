import zlib

import numpy as np
from pyspark.sql import functions as F

from sluiceway.llm import quality as Q


def text(good, i, words):
    t = words(40 + i % 30, i)
    return t.replace(" ", ". ", 3) if good else t.upper().replace(" ", "!! ")


def test_held_out_accuracy_and_bounds(frame, spark, words):
    rows = [(i, text(i % 5 > 0, i, words)) for i in range(400)] + [(1000, None), (1001, ""), (1002, words(30_000)), (None, "x"), (1003, "a"), (1003, "a")]
    docs = frame(rows)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert len(got) == 405 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 5 > 0) for i in held) >= 0.95 * len(held)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in Q.score(docs, model).collect() if r.score >= 0.5)


def test_labels_of_the_held_out_part_change_nothing(frame, spark, words):
    docs = frame([(i, text(i % 2, i, words)) for i in range(60)])
    rows = [(i, i % 2, 0) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in rows]
    a, b = (Q.score(docs, Q.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"))).orderBy("doc_id").collect() for x in (rows, flipped))
    assert a == b
    held = docs.select("doc_id", Q.in_training("doc_id").alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for r in held)


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells
    m = Q.fit(x, y, n_pairs=2)
    assert (0, 1) in m.pairs and ((m.score(x) >= 0.5) == (y > 0)).mean() > 0.9
    b = m.bins(x[:1])[0]
    z = m.base + sum(t[b[f]] for f, t in enumerate(m.mains)) + sum(t[b[f], b[g]] for (f, g), t in m.pairs.items())
    assert np.isclose(m.score(x[:1])[0], 1 / (1 + np.exp(-z)))


def test_without_labels_and_documents(frame, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame([(1, "a"), (2, None)])
    assert [r.score for r in Q.score(docs, Q.train(docs, none)).collect()] == [0.5, 0.5]
    assert Q.score(frame([]), Q.train(frame([]), none)).collect() == []
    bounded = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert Q.train(docs, bounded, most=1) is not None
