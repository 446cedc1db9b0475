import re

import numpy as np
import pytest

from folioscope.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, named = WORD.findall((t or "").translate(LOWER)), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if own := windows.get(tuple(w[k : k + s])):
                    hit |= set(range(k, k + s))
                    named |= own
        out.append((i, len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=str)


def found(docs, bench, **o):
    return sorted(((r.id, r.n_words, r.n_hit, r.items) for r in D.find_contamination(docs, bench, **o).collect()), key=str)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, "quick brown FOX jumps over the lazy dog and then"), (2, "one two"), (3, "One, two"), (4, None), (5, "!!!"), (None, "语 none"), (10, "quick brown fox jumps over the lazy dog and then it sleeps for"), (11, "x")]
    return spark.createDataFrame([(*r, "e") for r in items], "item_id int, text string, id string"), items


def test_documents(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in D.op4_decontaminate(spark, sf).collect()}
    want = {i: (n, h, len(x), h > 0) for i, n, h, x in brute(texts, items)}
    assert got == want and any(x[3] for x in got.values())


@pytest.mark.parametrize("pass_bytes", [1 << 20, 40])
def test_odd_rows(odd, none, bench, pass_bytes):
    df, items = bench
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, df, pass_bytes=pass_bytes) == brute(rows, items)
    assert found(none, df) == [] and {r[2] for r in found(odd, df.where("false"))} == {0}


def test_removal(odd, bench):
    out = D.decontaminated(odd, bench[0])
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == "The a very long while." and texts[6] == "" and texts[2] is None and texts[5] == "èéê " * 60


def test_index_counts_and_locates():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = D.FMIndex(text, 4, 5)
    patterns = np.zeros((60, 6), np.int64)
    lengths = rng.integers(1, 7, 60)
    for k, n in enumerate(lengths):
        patterns[k, :n] = rng.integers(1, 4, n)
    low, high = index.search(patterns, lengths)
    for k, n in enumerate(lengths):
        want = [i for i in range(len(text) - n + 1) if np.array_equal(text[i : i + n], patterns[k, :n])]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want
