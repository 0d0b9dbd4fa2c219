import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceway.llm import subword as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
V = S.Vocabulary.load(PATH)
OWN = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.one_of(st.text(max_size=40), st.text(alphabet="ab the▁ \n\t\0é亜", max_size=60))


def encode(texts, seed=1, dropout=0.0, **options):
    return [np.frombuffer(b, "<u4").tolist() for b in S.Encoder(V, seed, dropout, **options).encode(list(range(len(texts))), texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_without_dropout_the_models_own_ids(texts):
    texts = [t.replace("▁", "") for t in texts]
    assert encode(texts) == [OWN.encode(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4), st.sampled_from([0.0, 0.1, 0.5, 1.0]), st.integers(0, 5))
def test_decodes_without_loss(texts, dropout, seed):
    assert [V.decode(x) for x in encode(texts, seed, dropout)] == texts


def test_seeds_and_dropout_vary_the_pieces(words):
    t = [words(200, i) for i in range(3)]
    a, b, plain = encode(t, 1, 0.3), encode(t, 2, 0.3), encode(t)
    assert a == encode(t, 1, 0.3) and a != b and all(len(x) > len(p) for x, p in zip(a, plain, strict=True))
    assert len({tuple(x) for x in encode(["thoroughly"] * 40, 1, 0.3)}) > 1
    every = encode(t, 1, 1.0)
    assert all(len(x) >= len(s.replace(" ", "")) for x, s in zip(every, t, strict=True))


def test_both_agendas_agree(monkeypatch, words):
    w = [(x, k) for x in set(words(300).split() + ["▁▁▁", "aaaaaaa", "é亜", "the" * 15]) for k in (0, 1)]
    for dropout in (0.0, 0.2, 0.9):
        side = S.encode_words(w, V, 3, dropout)
        monkeypatch.setattr(S, "LONG", 0)
        assert S.encode_words(w, V, 3, dropout) == side
        monkeypatch.undo()


def test_operator(frame):
    rows = [(1, "some  text\n"), (1, "some  text\n"), (2, None), (3, ""), (None, "▁ x"), (4, "a" * 3000), (5, "word " * 20_000)]
    docs = frame(rows).withColumn("ids", F.lit("clash")).withColumn("source", F.lit("clash"))
    got = S.decode(S.encode(docs, PATH, seed=5, dropout=0.2), PATH).collect()
    assert sorted((repr(r.doc_id), r.text) for r in got) == sorted((repr(d), t or "") for d, t in rows)
    twice = [r.ids for r in got if r.doc_id == 1]
    assert twice[0] == twice[1] and [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    one = S.round_trip(docs, PATH, seed=5, dropout=0.2).collect()
    assert sorted((repr(r.doc_id), r.ids, r.text, r.source or "") for r in one) == sorted((repr(r.doc_id), r.ids, r.text, r.text) for r in got)
    assert S.round_trip(frame([]), PATH).collect() == []
    assert S.encode(frame([]), PATH).collect() == [] and S.decode(S.encode(frame([]), PATH), PATH).collect() == []


def test_decode_on_a_table(spark):
    rows = [(1, OWN.encode("some text, é亜\n"), "old"), (2, [], "old"), (3, None, None), (4, OWN.encode("\U0001f600 x"), "old")]
    got = S.decode(spark.createDataFrame(rows, "k int, pieces array<int>, text string"), PATH, "pieces")
    assert got.columns == ["k", "pieces", "text"]
    assert sorted((r.k, r.text) for r in got.collect()) == [(1, "some text, é亜\n"), (2, ""), (3, None), (4, "\U0001f600 x")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_of_many_texts_at_once(texts):
    words, counts = S._split(pa.array(texts, pa.string()))
    want = [S.words_of(t or "") for t in texts]
    assert [w.replace(" ", S.MARK) for w in words.to_pylist()] == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]


def test_every_merge_is_found():
    pairs = np.concatenate([V.pair[:-1], V.pair[:-1] + 1, [-1]])
    known = {p: i for i, p in enumerate(V.pair[:-1].tolist())}
    assert V.find(pairs).tolist() == [known.get(p, len(known)) for p in pairs.tolist()]


def brute_agenda(word, key, seed, dropout):
    """Over again: of all neighbours that make a piece and weren't skipped the best, the first of equals; it is merged, or
    skipped if its hash says so."""
    pieces = [(i, c) for i, c in enumerate(word)]
    skipped, score = set(), {OWN.id_to_piece(i): OWN.get_score(i) for i in range(OWN.get_piece_size()) if OWN.id_to_piece(i) in V.ids}
    while True:
        some = [(-score[a + b], i, a, b) for (i, a), (_, b) in zip(pieces, pieces[1:]) if a in V.ids and b in V.ids and a + b in score and (i, a, b) not in skipped]
        if not some:
            return [x for _, p in pieces for x in ([V.ids[p]] if p in V.ids else [V.byte_ids[b] for b in p.encode()])]
        _, i, a, b = min(some)
        one = lambda x: np.array([x], np.int64)
        if S._skipped(S._keyed(seed, one(key)), S._try(one(i), one(V.ids[a]), one(V.ids[b])), dropout)[0]:
            skipped.add((i, a, b))
        else:
            k = [p for p, _ in pieces].index(i)
            pieces[k : k + 2] = [(i, a + b)]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.9])
def test_dropout_against_a_brute_force_agenda(words, dropout):
    w = [(x, k) for k, x in enumerate(["▁thoroughly", "▁the", "▁aaaaaaaa", "é亜▁the", "▁internationalization", "x"] * 8 + words(20).split())]
    got = [np.frombuffer(b, "<u4").tolist() for b in S.encode_words(w, V, 3, dropout)]
    assert got == [brute_agenda(x, k, 3, dropout) for x, k in w]

@pytest.mark.parametrize("text, parts", [("", []), ("a b", ["▁a", "▁b"]), (" a  b\n\nc ", ["▁▁a", "▁▁b\n", "\n", "c", "▁"]), ("x▁y", ["▁x", "", "y"])])
def test_parts(text, parts):
    assert S.words_of(text) == parts


def test_each_occurrence_is_drawn_for_itself():
    """A word has no fixed few spellings: its occurrences in and across documents spell it in all likely ways."""
    assert len({tuple(x) for x in encode(["thoroughly"] * 1000, 1, 0.3)}) > 12
    n, whole = 4000, OWN.encode("a")  # one merge, of the mark and the letter
    for ids in (encode([" ".join(["a"] * n)], 1, 0.1)[0], sum(encode(["a"] * n, 1, 0.1), [])):
        assert abs(ids.count(whole[0]) / n - 0.9) < 0.03


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.4])
def test_what_is_remembered_changes_no_spelling(words, dropout):
    every = (words(60).split() + ["▁the", "▁of", "", "é亜" * 40, "▁thoroughly"]) * 20
    keys = np.arange(len(every)) * 977 - 5000
    want = b"".join(S.encode_words(list(zip(every, keys.tolist(), strict=True)), V, 5, dropout))
    for options in ({}, {"words": 3, "tries": 10}):
        e = S.Encoder(V, 5, dropout, **options)
        for _ in range(2):
            assert e._encode(every, keys)[0].tobytes() == want
