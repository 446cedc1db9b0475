import numpy as np
import pyarrow as pa

from folioscope.llm import suffix_dedup as D
from folioscope.llm.common import prefix_sums, span_hashes


def packed(batches):
    return pa.Table.from_batches(list(batches))


def test_window_names_keep_all_64_bits():
    data = np.frombuffer(b"".join(b"%05d" % i for i in range(40)), np.uint8)
    rows = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array([0], pa.int32()), pa.array([data.tobytes().decode()])], ["id", "row", "part", "text"])
    one = lambda x, kind: np.array([x], kind)
    runs = packed(D.rows_of(D.dealt(one(0, np.int64), row=one(1, np.int64), id=one(7, np.int64), first=one(0, np.uint32), count=one(151, np.uint16), open=one(1, np.uint8))))
    sent = D._windows(50, 3)(packed(D.packed_texts(iter([rows]))), runs)
    got = np.concatenate([D.unpack(x)["hash"] for x in sent["data"].to_pylist()])
    start = np.arange(151)
    assert set(got.tolist()) == set(span_hashes(prefix_sums(data), start, start + 50).tolist())


def test_windows_whose_names_share_48_bits_both_stay():
    name = np.array([0xABCD_0123_4567_0001, 0xABCD_0123_4567_0002, 0xABCD_0123_4567_0002], np.uint64)
    x = D.dealt(np.zeros(3, np.int64), hash=name, check=np.zeros(3, np.uint32), state=np.zeros(3, np.uint8), id=np.array([1, 2, 3]), row=np.array([1, 2, 3]), group=np.zeros(3, np.int32), first=np.zeros(3, np.uint32))
    found = D.joined([b for batch in D._past_threshold(D.rows_of(x)) for b in batch.column(1).to_pylist()])
    assert found["id"].tolist() == [3]


def test_windows_whose_names_share_64_bits_both_stay():
    check = np.array([1, 2, 2], np.uint32)
    x = D.dealt(np.zeros(3, np.int64), hash=np.full(3, 77, np.uint64), check=check, state=np.zeros(3, np.uint8), id=np.array([1, 2, 3]), row=np.array([1, 2, 3]), group=np.zeros(3, np.int32), first=np.zeros(3, np.uint32))
    found = D.joined([b for batch in D._past_threshold(D.rows_of(x)) for b in batch.column(1).to_pylist()])
    assert found["id"].tolist() == [3]


def test_second_names_are_independent():
    data = np.frombuffer(b"ab" * 40 + b"ba" * 40, np.uint8)
    h, check = D.window_names(data, np.arange(100), 50)
    assert len(set(h.tolist())) == len(set(check.tolist())) and (h >> np.uint64(32)).astype(np.uint32).tolist() != check.tolist()
