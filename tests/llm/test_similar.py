import numpy as np

import corpus_pipeline
from folioscope.llm import simhash as S

from .conftest import ROWS


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, least=0.8):
    """Smallest id of each row's component, from all pairs."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                a, b = label[i], label[j]
                label = [min(a, b) if x == max(a, b) else x for x in label]
    return [min(rows[j][0] for j in range(len(rows)) if label[j] == x) for x in label]


def planted():
    """Texts of 200 words, with copies in which 1 to 8 words are edited."""
    rng, rows = np.random.default_rng(5), []
    for base in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 3, 4, 6, 8):
            copy = list(words)
            for k in rng.choice(200, edits, replace=False):
                copy[k] = f"e{base}_{edits}_{k}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_edited_copies_are_one_group(spark, sf):
    rows = planted()
    known = [similarity(shingles(rows[i - i % 7][1]), shingles(t)) for i, (_, t) in enumerate(rows) if i % 7]
    assert sum(0.8 <= x < 0.95 for x in known) > 60 and sum(x < 0.8 for x in known) > 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.id: r.component_id for r in S.similar_documents(docs).collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute(rows), strict=True)}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == set(got.values())


def test_documents(documents, texts):
    got = {r.id: r.component_id for r in S.similar_documents(documents).collect()}
    assert got == {i: c for (i, _), c in zip(texts, brute(texts), strict=True)}


def test_odd_rows(odd, none):
    out = S.similar_documents(odd).collect()
    assert len(out) == len(ROWS) and {(0, 0), (1, 0), (None, 0), (2, 2), (3, 2), (4, 2)} <= {(r.id, r.component_id) for r in out}
    left = S.one_of_each(odd, groups=S.similar_documents)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [-5, 0, 2, 5, 6, 7, 9]  # 8 shares 14 of 16 shingles with 0
    assert S.similar_documents(none).count() == 0


def test_large_buckets_are_compared_as_all_pairs(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(1000, 9000, 40), np.arange(40)).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(rng.integers(0, 1 << 40, 30).astype(np.uint64)) for _ in range(9)]
    own, label = [set(x.tolist()) for x in sets], list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similarity(own[i], own[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x == max(a, b) else x for x in label]
    assert 10 < len(set(label)) < 80
    members = spark.createDataFrame([(b, i) for b in (5, 6) for i in range(len(sets))], "bucket bigint, key bigint")
    data = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "key bigint, data binary")
    for size in (1 << 20, 2000):
        got = {r.key: r.first for r in S.linked_in_buckets(members, data, 0.8, size).collect()}
        assert got == dict(enumerate(label))


def test_one_large_group_of_near_copies(spark):
    """Edited copies of one text, and a chain that drifts away from it: small blocks give the groups of all pairs."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(60):
        copy = list(words)
        for k in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            copy[k] = f"e{i}_{k}"
        rows.append((i, " ".join(copy)))
    for i in range(60, 90):
        words[(i * 7) % 120] = f"d{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.id: r.component_id for r in S.similar_documents(docs, block_bytes=3000).collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute(rows), strict=True)}
