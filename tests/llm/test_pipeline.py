import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from sluiceway.llm import packing, pii, quality

from .conftest import LOW
from .test_jaccard_join import brute, brute_set
from .test_pii import PATTERNS
from .test_pii import brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "personal data", "packing"]


def test_pipeline_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [(d, t) for d, t in rows if model.score(np.array([quality.features(t)]))[0] >= 0.5]
    last = {}
    for d, t in rows:
        last[t.translate(LOW)] = max(d, last.get(t.translate(LOW), d))
    rows = [(d, t) for d, t in rows if last[t.translate(LOW)] == d]
    stays = {int(d) for d, _, c in brute(rows, 5, 80, 100) if d == c}
    kept = [(d, t) for d, t in rows if d in stays]
    assert len(kept) < len(rows)
    weights = pii.train(spark.createDataFrame(kept, "doc_id long, text string"))
    clean = [(d, pii.redacted(t, pii.find([t], weights)[0][1])) for d, t in kept]
    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean}
    got = C.run(spark, SF).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert total == want


@pytest.mark.parametrize("k", range(4))
def test_stages_return_the_columns_of_documents(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert C.STAGES[k][1](spark, docs.limit(0), SF).columns == docs.columns


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def rows_of(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_warc", "op9_exact_dedup"])
def test_queries_against_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_op1(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op1_quality")}
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for d, t in docs:
        x = np.array([quality.features(t)])
        z = model.base + sum(table[np.searchsorted(e, v, "right")] for table, e, v in zip(model.mains, model.edges, x[0], strict=True))
        z += sum(t2[np.searchsorted(model.edges[f], x[0, f], "right"), np.searchsorted(model.edges[g], x[0, g], "right")] for (f, g), t2 in model.pairs.items())
        assert got[d].score == pytest.approx(1 / (1 + np.exp(-z))) and got[d].predicted == (got[d].score >= 0.5)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
    assert len(got) == len(docs)


def test_op3(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op3_sentencepiece")}
    assert len(got) == len(docs) and all(r.lossless and r.n_tokens >= (len(dict(docs)[d]) > 0) for d, r in got.items())


def test_op4(spark):
    """The generator's pages have one article each: its text, decoded, block by block."""
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows_of(spark, "op4_html_text")
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article[^>]*>(.*)</article>", pages[r.page_id], re.S)
        want = re.sub(r"<br\s*/?>", " ", inner[1] if inner else "")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|table|tr|td|blockquote|pre|section)\b[^>]*>", want)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_op6(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op6_pii")}
    names = [k for k, _ in PATTERNS]
    for d, t in docs:
        want = brute_spans(t)
        told = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert got[d].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(got[d].spans.split(","))
        assert [got[d][f"n_{k}"] for k in names] == [sum(names[x] == k for _, x, _ in want) for k in names]


def test_op7(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op7_fingerprint")}
    for i, (d, t) in enumerate(docs):
        half, after = len(t) // 2, docs[(i + 1) % len(docs)][1]
        edited = t[: len(t) - half] + after[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((got[d].near_edited, edited), (got[d].near_next, after)):
            a, b = brute_set(t, 5), brute_set(other, 5)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.25
    assert len(got) == len(docs)


def test_op8(spark, docs):
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in rows_of(spark, "op8_jaccard_join"))
    assert got == brute(docs, 4, 85, 100)


def test_op10(spark, docs):
    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in docs}
    found, filled = {d: 0 for d, _ in docs}, {}
    rows = rows_of(spark, "op10_packing")
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == found[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        found[r.doc_id] += r.length
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert found == {d: len(x) for d, x in ids.items()} and max(filled.values()) <= packing.CAPACITY == 4096
    assert sum(n < 4096 for n in filled.values()) <= 1
