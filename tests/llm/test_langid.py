import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import langid as L

from .conftest import ROWS


def test_held_out_accuracy(spark, sf, documents):
    got = L.op6_langid(spark, sf).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == documents.count() and len(held) > 40
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_vectors_are_sums_of_bound_letters(monkeypatch):
    text = "Ab, ba!"
    v, letters = L.text_vectors([text, "12 !", None, "Ab" * 40], 64)
    spelled = [0, ord("a"), ord("b"), 0, ord("b"), ord("a"), 0]
    one = {p: L.letter_vectors(np.array([p]), 64)[0].astype(int) for p in spelled}
    want = sum(np.roll(one[a], 2) * np.roll(one[b], 1) * one[c] for a, b, c in zip(spelled, spelled[1:], spelled[2:], strict=False))
    assert np.array_equal(v[0], want) and letters.tolist() == [4, 0, 0, 80] and not v[1].any()
    monkeypatch.setattr(L, "CHARS_AT_ONCE", 7)
    monkeypatch.setattr(L, "GRAMS_AT_ONCE", 2)
    monkeypatch.setattr(L, "CELLS", 4)
    assert np.array_equal(L.text_vectors([text, "12 !", None, "Ab" * 40], 64)[0], v)


def test_odd_rows(odd, none):
    model = L.train(odd)
    got = [(r.id, r.lang_pred, r.score) for r in L.identify(odd, model).collect()]
    assert len(got) == len(ROWS)
    assert {i for i, lang, s in got if lang == "und"} == {2, 3, 4, -5} and all(s == 0 for _, lang, s in got if lang == "und")
    assert {lang for _, lang, _ in got} <= {"und", "en", "fr", "zh"}
    empty = L.train(none)
    assert empty[0] == [] and {r.lang_pred for r in L.identify(odd, empty).collect()} == {"und"}
    assert L.identify(none, model).count() == 0


def brute(rows):
    """(lang, score) by id, with a dictionary of n-gram counts and one bound vector for each n-gram."""
    grams, bound = {}, {}
    for i, text, _ in rows:
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        words = re.findall("[^ ]+", letters)
        line = [0, *(ord(c) for c in " ".join(words)), 0] if words else []
        line = [0 if p == 32 else p for p in line]
        grams[i] = Counter(zip(line, line[1:], line[2:], strict=False))
        for g in grams[i]:
            if g not in bound:
                a, b, c = L.letter_vectors(np.array(g), L.DIMENSIONS).astype(int)
                bound[g] = np.roll(a, 2) * np.roll(b, 1) * c
    whole = {i: sum((n * bound[g] for g, n in own.items()), np.zeros(L.DIMENSIONS)) for i, own in grams.items()}
    size = lambda v: v / max(np.linalg.norm(v), 1e-300)
    prototypes = {}
    for i, _, lang in rows:
        if lang is not None and grams[i] and zlib.crc32(str(i).encode()) % 3 != 1:
            prototypes[lang] = prototypes.get(lang, 0) + size(whole[i])
    out = {}
    for i, own in grams.items():
        near = {lang: float(size(p) @ size(whole[i])) for lang, p in prototypes.items()}
        out[i] = max(near.items(), key=lambda x: x[1]) if own else ("und", 0.0)
    return out


def test_every_document_against_brute_force(spark, sf, documents):
    want = brute([(r.doc_id, r.text, r.lang) for r in documents.collect()])
    got = {r.doc_id: r for r in L.op6_langid(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (lang, score) in want.items():
        assert got[i].score == pytest.approx(max(score, 0), abs=1e-4) and (got[i].lang_pred == lang or abs(score) < 1e-4)
