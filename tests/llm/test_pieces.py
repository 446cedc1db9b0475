import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from folioscope.llm import pieces as P
from folioscope.llm.common import flat

from .conftest import ROWS

ODD = ["", " ", "a  b\n c", "é\x00x", "  x   ", "語" * 300 + " 日本語", "x" * 3000, "\n\n", "    " * 20 + "a", None, "😀 ok 😀😀", "a" * 97, "<s> </s> <unk> <0x41>", "tab\tand\rmore "]


@pytest.fixture(scope="module")
def model():
    return P.Pieces.load(P.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def encoded(rows, model):
    data, at = flat(pa.array(rows, pa.string()))
    return *P.encode_texts(data, at, model), data, at


def test_same_ids_as_the_library(texts, model, library):
    rows = ODD + [t for _, t in texts]
    ids, edge, data, at = encoded(rows, model)
    for i, t in enumerate(rows):
        assert ids[edge[i] : edge[i + 1]].tolist() == library.encode(t or ""), t[:50]
    back, back_at = P.decode_ids(ids, edge, model)
    assert np.array_equal(back, data) and np.array_equal(back_at, at)


def test_piece_marks_in_texts_survive(model):
    rows = ["a▁b", "▁", " ▁ "]
    ids, edge, data, _ = encoded(rows, model)
    assert np.array_equal(P.decode_ids(ids, edge, model)[0], data)


def test_documents(spark, sf, texts, library):
    got = {r.doc_id: r for r in P.op5_sentencepiece(spark, sf).collect()}
    assert len(got) == len(texts) and all(r.round_trip for r in got.values())
    assert all(list(got[i].ids) == library.encode(t) for i, t in texts[:20])


def test_odd_rows(odd, none):
    out = P.encode(odd)
    assert out.count() == len(ROWS) and {r.round_trip for r in out.collect()} == {True} and P.encode(none).count() == 0
    back = sorted((r.id, r.text) for r in P.decode(out).where("id is not null").collect())
    assert back == sorted((r[0], r[1] or "") for r in ROWS if r[0] is not None)


def test_occurrences():
    data = np.frombuffer(b"abracadabra abra", np.uint8)
    words = [b"a", b"abra", b"bra ", b"zz", b"ra"]
    got = [[] for _ in words]
    for which, at in P.occurrences(data, words, 4):
        for w, p in zip(which.tolist(), at.tolist(), strict=True):
            got[w].append(p)
    assert [sorted(x) for x in got] == [[0, 3, 5, 7, 10, 12, 15], [0, 7, 12], [8], [], [2, 9, 14]]
