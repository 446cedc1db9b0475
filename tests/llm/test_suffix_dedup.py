import hashlib

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import suffix_dedup as S

from .conftest import ROWS


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1) if i is not None else ():
            w = b[k : k + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n_spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, length=50, **o):
    return sorted(((r.id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in S.repeated_spans(df, length=length, **o).collect()), key=str)


def test_documents(spark, sf, texts):
    got = sorted((tuple(r) for r in S.op1_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(texts)


def test_odd_rows(odd, none):
    assert found(odd) == brute([r[:2] for r in ROWS])
    assert found(none) == []


@pytest.mark.parametrize(("length", "gram"), [(8, 3), (8, 8), (5, 1), (12, 5)])
def test_small_alphabets(spark, length, gram, monkeypatch):
    rng = np.random.default_rng(length)
    rows = [(int(i), "".join(rng.choice(list("abé"), rng.integers(0, 90)))) for i in rng.permutation(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    assert found(df, length, gram=gram) == brute(rows, length)


def test_texts_over_several_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefgh"), 6000))
    rows = [(1, base[:5000]), (2, base[1000:] + base[:900]), (3, base[2500:2560])]
    data = spark.createDataFrame(rows, "doc_id int, text string")
    want = brute(rows)
    assert found(data) == want
    tiles = []
    monkeypatch.setattr(S, "TILE_BYTES", 700)
    raw = np.frombuffer(base.encode(), np.uint8)
    for text, first, count, _, _ in S.sampled(raw, np.array([0, 6000]), 50, 20):
        tiles += [w for f, c in zip(first, count, strict=True) for w in range(f, f + c)]
    assert sorted(tiles) == list(range(6000 - 49))


def test_text_column_keeps_characters_and_rows(odd):
    out = S.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert (2, None) in kept and (1, "") in kept and (8, "prefix  suffix") in kept and (5, "èéê " * 60) in kept


def test_packing_round_trip():
    x = {"a": np.arange(7, dtype=np.uint64) << np.uint64(40), "b": np.array([1, -2, 3], np.int64), "c": np.zeros(0, np.uint16)}
    y = S.unpack(S.pack(**x))
    assert all(np.array_equal(x[k], y[k]) and x[k].dtype == y[k].dtype for k in x)


def hot_rows(n, seed):
    """Random texts that all hold a line of 20 to 49 bytes, some also passages of others."""
    rng = np.random.default_rng(seed)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnop "), k))
    line = "the same thirty bytes in each." + "x" * 6
    out = [(i, word(60) + line + word(70)) for i in range(n)]
    out += [(n + i, out[int(rng.integers(0, n))][1][20:110] + word(30) + out[int(rng.integers(0, n))][1][40:]) for i in range(n // 5)]
    return [out[i] for i in rng.permutation(len(out)).tolist()]


def test_a_line_in_every_row(spark, monkeypatch):
    rows = hot_rows(400, 5)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert found(df.repartition(2)) == brute(rows)
    assert found(df.repartition(7)) == brute(rows)


def test_hot_ranks_pass_their_bucket():
    rows = hot_rows(400, 6)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows])], ["id", "row", "part", "text"])
    x = S.joined([d for b in S._scan(50, 20, 8)(iter([batch])) for d in b.column(1).to_pylist()])
    _, n = np.unique(x["rank"][x["state"] == S.ASKS], return_counts=True)
    assert n.max() <= S.HOT and (x["state"] == S.GOES_ON).sum() > 300


def test_two_exchanges_deal_as_one(spark):
    rng = np.random.default_rng(1)
    blobs = []
    for k in range(40):
        part, row = rng.integers(0, 23, 50), rng.integers(0, 9, 50)
        blobs += list(S.dealt(part, row=row, id=row + 5, first=rng.integers(0, 1 << 30, 50).astype(np.uint32)))
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in blobs], "part int, data binary").repartition(3)
    want = [sorted(x) for x in zip(*[S.joined([d for _, d in blobs])[k].tolist() for k in ("row", "id", "first")], strict=True)]
    for fan_out in (100, 4):
        out = S.to_buckets(df, 23, fan_out)
        assert out.rdd.getNumPartitions() == 23
        rows = out.collect()
        got = [sorted(x) for x in zip(*[S.joined([bytes(r.data) for r in rows])[k].tolist() for k in ("row", "id", "first")], strict=True)]
        assert sorted(got) == sorted(want)
        spread = out.selectExpr("part", "spark_partition_id() AS p").distinct().collect()
        assert all(r.part == r.p for r in spread)


def test_columns_with_the_names_of_the_operator(spark):
    rows = [(i, t, "k", "r", "n", 1, 2) for i, t in hot_rows(30, 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, kept string, __row string, __null string, row int, hash int")
    out = S.without_repeats(df)
    assert out.columns == df.columns and {tuple(r[2:]) for r in out.collect()} == {("k", "r", "n", 1, 2)}


def test_prefix_doubling_gives_the_same_windows(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i), "".join(rng.choice(list("abé"), rng.integers(0, 90)))) for i in rng.permutation(50)] + [(50, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    for length in (8, 11):
        first = {}
        texts = {i: (t or "").encode() for i, t in rows}
        for i in sorted(texts):
            for k in range(len(texts[i]) - length + 1):
                first.setdefault(texts[i][k : k + length], i)
        want = {(i, k) for i, b in texts.items() for k in range(len(b) - length + 1) if first[b[k : k + length]] < i}
        assert {tuple(r) for r in S.doubled_windows(df, length=length).collect()} == want and want
        removed = {i: n for i, _, n, _, _ in found(df, length, gram=3)}
        assert removed == {i: len({j for w, k in want if w == i for j in range(k, k + length)}) for i, _ in rows}


def test_buckets_that_share_a_partition_take_one_exchange(spark, monkeypatch):
    rows = hot_rows(300, 8) + [(1000 + i, t) for i, t in hot_rows(300, 9)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    monkeypatch.setattr(S, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(S, "FAN_OUT", 4)
    exchanges, kept = [], S.stored

    def stored(df):
        exchanges.append(df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression"))
        return kept(df)

    monkeypatch.setattr(S, "stored", stored)
    assert found(df) == brute(rows)
    assert set(exchanges) == {1} and len(exchanges) == 1 + S.PASSES


def test_a_task_parts_its_buckets(monkeypatch):
    monkeypatch.setattr(S, "SPLIT_BYTES", 3000)
    rng = np.random.default_rng(4)
    n = 5000
    row = rng.integers(0, 40, n)
    x = {"hash": rng.integers(0, 1 << 63, n).astype(np.uint64), "row": row, "id": row + 3, "state": rng.integers(0, 2, n).astype(np.uint8)}
    bucket = S.bucket_of(x, "hash", 20)
    for part in range(3):
        own = bucket // 8 == part
        cuts = np.array_split(np.flatnonzero(own), 9)
        blobs = [d for c in cuts for _, d in S.dealt(np.full(len(c), part), **{k: v[c] for k, v in x.items()})]
        batches = [next(S.rows_of([(part, d)])) for d in blobs]
        out = list(S.by_bucket(iter(batches), "hash", 20, 8))
        assert [set(S.bucket_of(y, "hash", 20).tolist()) for y in out] == [{b} for b in range(part * 8, min(20, part * 8 + 8))]
        assert sorted(zip(*[np.concatenate([y[k] for y in out]).tolist() for k in x], strict=True)) == sorted(zip(*[v[own].tolist() for v in x.values()], strict=True))
    assert list(S.by_bucket(iter([]), "hash", 20, 8)) == [] == list(S.by_bucket(iter([]), "hash", 20, 1))


def test_the_text_is_not_joined_to_itself(spark):
    def joins(plan):
        children = [plan.children().apply(k) for k in range(plan.children().size())]
        return [plan] * (plan.nodeName() == "Join") + [j for c in children for j in joins(c)]

    df = spark.createDataFrame([(i, t, i) for i, t in hot_rows(30, 11)], "doc_id int, text string, n int")
    (join,) = joins(S.without_repeats(df)._jdf.queryExecution().optimizedPlan())
    columns = join.children().apply(0).output()
    assert not any("string" in columns.apply(k).dataType().catalogString() for k in range(columns.size()))
