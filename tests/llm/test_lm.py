import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import lm

from .conftest import ROWS

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(rows):
    counts, words = Counter(), []
    for i, t in rows:
        w = [*WORD.findall((t or "").translate(LOWER)), None]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        words.append((i, held, w))
        if not held:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    return [(i, h, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)) for i, h, w in words]


def close(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_documents(spark, sf, texts):
    got = [tuple(r) for r in lm.op3_lm_score(spark, sf).collect()]
    close(got, base(texts))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_odd_rows(odd, none):
    got = [tuple(r) for r in lm.score_texts(odd, lm.held_out()).collect()]
    close(got, base([r[:2] for r in ROWS]))
    assert all(math.isfinite(r[6]) for r in got)
    assert lm.score_texts(none, lm.held_out()).count() == 0
    unlearnt = [tuple(r) for r in lm.score_texts(odd, F.lit(True)).collect()]
    assert {r[3] for r in unlearnt} == {0} and {r[5] for r in unlearnt} == {0.0}


def toy(counts, monkeypatch=None, top=None):
    """Symbols of a few words, in classes 0, 1, 2, 0, ..."""
    if top is not None:
        monkeypatch.setattr(lm, "TOP", top)
    words = np.array([(i + 1, i % 3, n) for i, n in enumerate(counts)], np.int64)
    classes = np.stack([np.bincount(words[:, 1], minlength=lm.CLASSES) + 2, np.bincount(words[:, 1], words[:, 2], minlength=lm.CLASSES) + 5], axis=1).astype(np.int64)
    return lm.Symbols.made(words, classes, 4)


def test_probabilities_are_normalised(monkeypatch):
    rng = np.random.default_rng(0)
    symbols = toy(range(40, 20, -1), monkeypatch, 5)
    model = lm.LogBilinear(symbols)
    n = symbols.end + 1
    model.train(rng.integers(0, n, 6000), rng.integers(0, n + 1, (6000, lm.CONTEXT)), rng, {})
    for scale in (1, 60):
        model.values[2] *= scale
        context = np.tile(rng.integers(0, n + 1, lm.CONTEXT), (n, 1))
        assert np.sum(10 ** model.log10_probabilities(np.arange(n), context)) == pytest.approx(1, abs=1e-4)


def test_training_learns_what_follows_what(monkeypatch):
    for top in (3, 0):  # words of the first step, and members of classes
        rng = np.random.default_rng(1)
        symbols = toy([9, 9, 9], monkeypatch, top)
        y = symbols.symbol[np.arange(60_000) % 3]
        context = np.stack([np.roll(y, j) for j in range(1, lm.CONTEXT + 1)], axis=1)
        mixed = rng.permutation(len(y))
        model, state = lm.LogBilinear(symbols), {}
        for _ in range(12):
            model.train(y[mixed], context[mixed], rng, state)
        assert 10 ** model.log10_probabilities(y[9:18], context[9:18]).mean() > 0.8


def test_scores_against_a_plain_scorer(spark, documents, texts, monkeypatch):
    seen, fit = {}, lm.fit

    def kept(groups, symbols, n):
        seen["symbols"], seen["model"] = symbols, fit(groups, symbols, n)
        return seen["model"]

    monkeypatch.setattr(lm, "fit", kept)
    monkeypatch.setattr(lm, "WORDS", 300)
    got = {r.id: r for r in lm.score_texts(documents, lm.held_out()).collect()}
    symbols, model = seen["symbols"], seen["model"]
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 == 2, WORD.findall((t or "").translate(LOWER))) for i, t in texts]
    counts = Counter(w for _, _, held, words in rows if not held for w in words)
    by_hash = {}
    for w in {w for r in rows for w in r[3]}:
        data = np.frombuffer(w.encode(), np.uint8)
        start, end = np.array([0]), np.array([len(data)])
        by_hash[w] = (int(lm.word_table(data, np.array([0, len(data)]), ~lm.SPACES)[2][0]), int(lm.word_class(data, start, end)[0]))
    own = dict(zip(symbols.hashes.tolist(), symbols.symbol.tolist(), strict=True))
    seen_v, places, out, bias, tail, tail_bias = (v.astype(float) for v in model.values)
    others = Counter()
    for w, n in counts.items():
        if by_hash[w][0] not in own:
            others[by_hash[w][1]] += n + 1

    def log_probability(word, before):
        h, k = by_hash[word] if word is not None else (None, None)
        x = symbols.end if word is None else own.get(h, symbols.top + int(symbols.first[k + 1]) - 1)
        q = sum(seen_v[c] @ places[j] for j, c in enumerate(before))
        head = q @ out.T + bias
        at = model.outputs - 1 if word is None else x if x < symbols.top else symbols.top + k
        value = head[at] - np.log(np.exp(head).sum())
        if symbols.top <= x < symbols.end:
            a, b = symbols.first[k], symbols.first[k + 1]
            score = q @ tail[a:b].T + tail_bias[a:b]
            value += score[x - symbols.top - a] - np.log(np.exp(score).sum())
            if h not in own:
                value += math.log((counts[word] + 1) / (others[k] + 1))
        return value / math.log(10), x

    for i, _, _, words in rows[:40]:
        before, total = [symbols.end + 1] * lm.CONTEXT, 0.0
        for w in [*words, None]:
            value, x = log_probability(w, before)
            total, before = total + value, [x, *before[:-1]]
        assert got[i].score == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_scores_do_not_depend_on_the_input_layout(documents, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_BYTES", 1 << 14)
    found = [{r.id: r.score for r in lm.score_texts(documents.repartition(n), lm.held_out()).collect()} for n in (1, 6)]
    assert found[0] == found[1]
