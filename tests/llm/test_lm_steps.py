"""What a step computes: the same numbers as plain loops, and nothing that it does not use."""

import numpy as np
import pytest

from folioscope.llm import lm

from .test_lm import toy


def test_words_with_symbols_of_their_own_get_no_class(monkeypatch):
    seen, word_class = [], lm.word_class
    monkeypatch.setattr(lm, "word_class", lambda data, start, end: seen.append(len(start)) or word_class(data, start, end))
    data = np.frombuffer(b"aa bb aa cc aa dd", np.uint8)
    at = np.array([0, 5, 5, len(data)])
    start, end, hashes = lm.word_table(data, at, ~lm.SPACES)
    words = np.array([(h, k, 2) for h, k in zip(hashes[[0, 1]].view(np.int64).tolist(), word_class(data, start, end)[[0, 1]].tolist(), strict=True)], np.int64)
    classes = np.stack([np.bincount(words[:, 1], minlength=lm.CLASSES)] * 2, axis=1).astype(np.int64) * 2
    symbols = lm.Symbols.made(words, classes, 3)
    target, text, _ = symbols.sequences(data, at)
    assert seen == [2]  # cc and dd
    assert text.tolist() == [0, 0, 0, 1, 2, 2, 2, 2, 2]
    a, b = symbols.own(hashes[:2])
    c, d = symbols.top + symbols.first[1:][word_class(data, start, end)[[3, 5]]] - 1
    assert target.tolist() == [a, b, symbols.end, symbols.end, a, c, a, d, symbols.end]


def test_members_of_classes_compute_no_gradient_of_predictions(monkeypatch):
    found, gradients = [], lm.Softmax.gradients

    def kept(self, *args, **named):
        found.append((self, gradients(self, *args, **named)))
        return found[-1][1]

    monkeypatch.setattr(lm.Softmax, "gradients", kept)
    symbols, rng = toy(range(40, 20, -1), monkeypatch, 5), np.random.default_rng(0)
    model = lm.LogBilinear(symbols)
    model.train(rng.integers(0, symbols.end + 1, 500), rng.integers(0, symbols.end + 2, (500, lm.CONTEXT)), rng, {})
    heads = [g for s, g in found if s is model.head]
    tails = [g for s, g in found if s is not model.head]
    assert heads and all(g[0] is not None for g in heads)
    assert tails and all(g[0] is None for g in tails)


def test_gradients_against_a_plain_loop():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 50, 30)
    soft, q, out, bias = lm.Softmax(counts), *(rng.normal(0, 1, s).astype(np.float32) for s in ((70, 24), (30, 24), (30,)))
    y = rng.integers(0, 30, 70)
    got = soft.gradients(q, y, out, bias, np.random.default_rng(3))
    drawn = np.searchsorted(np.cumsum((counts + 1) / (counts + 1).sum()), np.random.default_rng(3).random(lm.NOISE))
    want = [np.zeros(x.shape) for x in (q, out, bias)]
    for i, row in enumerate(q.astype(float)):
        for k, real in [(y[i], 1), *((k, 0) for k in drawn)]:
            g = real - 1 / (1 + np.exp(-(row @ out[k] + bias[k] - np.log(lm.NOISE * soft.noise[k]))))
            want[0][i] += g * out[k]
            want[1][k] += g * row
            want[2][k] += g
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("width", [1, 5, 24])
def test_summed_rows(width):
    rng = np.random.default_rng(5)
    index, rows = rng.integers(0, 40, 300), rng.normal(0, 1, (300, width)).astype(np.float32)
    own, sums = lm.summed_rows(index, rows)
    assert own.tolist() == sorted(set(index.tolist()))
    assert sums == pytest.approx(np.stack([rows[index == k].sum(axis=0) for k in own]), abs=1e-4)
