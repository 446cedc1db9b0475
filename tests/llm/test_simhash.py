import numpy as np
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import simhash as S

from .conftest import ROWS


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents(spark, sf, texts):
    got = S.op10_simhash(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = S.brute_components(texts)
    assert (got.to_numpy() == want.to_numpy()).all()
    assert [f"{plain_fingerprint(t):016x}" for _, t in texts] == want.fingerprint.tolist()


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join("".join(rng.choice(list("ab"), rng.integers(1, 9))) for _ in range(5000)) + "\n" + "z" * 5000 + " end"
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "SPLIT_BYTES", 97)
    monkeypatch.setattr(S, "WORDS_AT_ONCE", 11)
    assert S.fingerprint(text) == want == plain_fingerprint(text)


def test_index_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ flip() for _ in range(4)], *[base ^ flip() ^ flip() for _ in range(4)], *[base ^ flip() ^ flip() ^ flip() for _ in range(3)]]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for limit in (1, 2, 3):
        want = {(i, j) for i, j in zip(*np.where(near <= limit), strict=True) if i < j}
        got = {(min(a, b), max(a, b)) for x, y in S.linked_pairs(fps, limit) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        assert got == want
        for blocks in (limit + 1, limit + 2):
            met = set()
            for fixed, spans in S.block_choices(limit, blocks):
                met |= {(min(a, b), max(a, b)) for x, y in S.linked_pairs(S.rearranged(fps, spans), limit, fixed) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
            assert met == want


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert np.array_equal(S.gray_rank(n ^ (n >> np.uint64(1))), n)


def test_chains_make_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    roots = {r.node: r.root for r in S.star_components(links).collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {101: 100}


def test_odd_rows(odd, none):
    out = {(r.id, r.component_id) for r in S.near_duplicates(odd).collect()}
    assert {(0, 0), (1, 0), (None, 0), (2, 2), (3, 2), (4, 2)} <= out
    assert S.near_duplicates(odd).count() == len(ROWS) and S.near_duplicates(none).count() == 0
    left = S.one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect()) == [-5, 0, 2, 5, 6, 7, 8, 9]
    assert S.one_of_each(none).count() == 0


def test_native_hash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two")).alias("h")).first().h == np.array([xxhash.xxh64_intdigest(b"one two", 42)], np.uint64).view(np.int64)[0]
