import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluiceway.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aAé' s\n\t\x1c\x85Σİ1!<|endoftext>́", max_size=30)), max_size=5))
def test_ids_are_the_tokenizers_own(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in ENCODER.encode(texts)]
    assert got == whole(texts)


ENCODER = K.WordTokens(SPEC, words=50)


@pytest.mark.parametrize("capacity, windows, bundle", [(4096, 8, 64), (16, 3, 2), (64, 1, 1)])
def test_pieces(frame, words, capacity, windows, bundle):
    rows = [(i, words(3 + i * 5 % 40, i)) for i in range(60)] + [(100, None), (101, ""), (102, words(9000)), (None, "null id"), (103, "İΣ <|endoftext|> é")]
    got = K.pack(frame(rows), SPEC, capacity=capacity, windows=windows, bundle=bundle).collect()
    ids = dict(zip((d for d, _ in rows), whole([t for _, t in rows]), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for d, ps in pieces.items():
        at = 0
        for r in sorted(ps, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : at], "<u4").tobytes())
        assert at == len(ids[d])
    partial = 0
    for ps in sequences.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        partial += at < capacity
    assert partial <= max(1, -(-3 // bundle))


def test_rows_that_repeat_an_id_and_no_rows(frame):
    got = K.pack(frame([(1, "a b"), (1, "a b")]), SPEC).collect()
    assert sorted(r.offset for r in got) == [0, 3] and {r.length for r in got} == {3}
    assert K.pack(frame([]), SPEC).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 4))
def test_best_fit_keeps_every_token(sizes, windows):
    out = []
    p = K.Packer(out.append, 16, windows)
    for d, n in enumerate(sizes):
        p.add(d, 0, b"abcd" * n, n)
        assert len(p.open) <= windows
    assert all(sum(len(x[2]) // 4 for x in w) == 16 for w in out)
    p.merge()
    assert sum(len(x[2]) // 4 for w in out for x in w) == sum(sizes) and len(out) == -(-sum(sizes) // 16)
