"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of spaces with the word behind it) are laid end to end and their suffixes sorted;
every piece is binary-searched for the range of suffixes that begin with it, which gives all its occurrences at once.
These edges go into a table by position, and the relaxation works on it. For a model of merges, relaxing means: join the
two neighbours whose piece has the best score, the leftmost of equals, until none is left; all units advance together.
Characters without a piece become byte pieces.

Decoding gives back the exact text: a U+2581 in a text is written as bytes, as its own piece stands for a space.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, prefix_sums, read, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that share a suffix array.
BATCH_BYTES = 3 << 19
#: Characters of a unit that all advance in one table; longer units go through a heap.
LONG_UNIT = 96
#: Cells of a table of units.
CELLS = 1 << 20
#: Edges that are placed at a time.
EDGES_AT_ONCE = 1 << 20
SPACE = 0x20


@dataclass
class Pieces:
    """A model's pieces, with the space for U+2581."""

    texts: list[bytes]
    ids: np.ndarray
    order: np.ndarray  # place of each id's piece by score, best first; equal scores are equal; past the last id: none
    byte_ids: np.ndarray
    decoded: list[bytes]  # by id
    longest: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a SentencePiece model file of merges with byte fallback, identity normalisation and a dummy prefix."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("the model isn't one of merges with byte fallback, identity normalisation and a dummy prefix")
        none = np.iinfo(np.int32).max
        texts, ids, decoded = [], [], []
        byte_ids, scores = np.zeros(256, np.int32), np.full(len(model.pieces) + 1, np.nan)
        for i, p in enumerate(model.pieces):
            data = p.piece.replace("▁", " ").encode()
            if p.type == 6:
                byte_ids[int(p.piece[3:5], 16)] = i
                decoded.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 1:
                if b" " in data.lstrip(b" "):
                    raise ValueError("a piece spans words")
                texts.append(data)
                ids.append(i)
                scores[i] = p.score
                decoded.append(data)
            else:
                decoded.append(b"")
        known = ~np.isnan(scores)
        order = np.full(len(scores), none, np.int32)
        order[known] = np.unique(-scores[known], return_inverse=True)[1]
        return cls(texts, np.array(ids, np.int32), order, byte_ids, decoded, max(map(len, texts), default=1))


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number, zeros past the end."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : n + k]
    return out


def suffix_order(data: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` bytes from each: eight at once, then doubled."""
    n = len(data)
    order = np.argsort(first)
    step = 8
    while True:
        key = first[order] if step == 8 else key[order]
        if step >= depth:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
        ahead = np.full(n, 0, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key)
        step *= 2


def occurrences(data: np.ndarray, texts: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, position) of every occurrence of every text, by binary search in the suffix order; some at a time."""
    first = words8(data)
    order = suffix_order(data, first, longest)
    n, m, wide = len(data), len(texts), -(-longest // 8)
    padded = np.frombuffer(b"".join(t.ljust(8 * wide, b"\0") for t in texts), ">u8").reshape(m, wide).astype(np.uint64)
    size = np.array([len(t) for t in texts])
    mask = np.zeros((m, wide), np.uint64)
    for k in range(wide):
        held = np.clip(size - 8 * k, 0, 8)
        mask[:, k] = np.where(held == 0, 0, ~np.uint64(0) << (np.uint64(64) - 8 * np.maximum(held, 1).astype(np.uint64)))
    ahead = np.concatenate((first, np.zeros(8 * wide, np.uint64)))

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
        for _ in range(int(n).bit_length() + 1):
            live = low < high
            mid = (low + high) // 2
            at = order[np.minimum(mid, n - 1)]
            less, same = np.zeros(m, bool), np.ones(m, bool)
            for k in range(wide):
                x = ahead[at + 8 * k] & mask[:, k]
                less |= same & (x < padded[:, k])
                same &= x == padded[:, k]
            right = live & (less | same if after else less)
            low = np.where(right, mid + 1, low)
            high = np.where(live & ~right, mid, high)
        return low

    low, high = bound(False), bound(True)
    count = high - low
    cuts = np.flatnonzero(np.diff(np.cumsum(count) // EDGES_AT_ONCE)) + 1
    for part in np.split(np.arange(m), cuts):
        n_each = count[part]
        which = np.repeat(part, n_each)
        rows = np.repeat(low[part] - (np.cumsum(n_each) - n_each), n_each) + np.arange(len(which))
        yield which, order[rows]


def _heap_units(start: int, n: int, table: np.ndarray, order: np.ndarray, after: np.ndarray) -> None:
    """Merges of one long unit of n characters from ``start``; ``after`` gets the end of each symbol, 0 where none begins."""
    width = table.shape[1]
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    worst = int(order[-1])
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (k := end[end[i]] - i) <= width and (o := int(order[table[start + i, k - 1]])) < worst:
            heapq.heappush(heap, (o, i, i + k))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop or not end[i] > i:
            continue
        gone = end[i]
        end[i], end[gone] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    after[start : start + n] = np.array(end) + np.where(np.array(end) > 0, start, 0)


def _table_units(starts: np.ndarray, n: int, table: np.ndarray, order: np.ndarray, after: np.ndarray) -> None:
    """Merges of all units of n characters together."""
    width, worst = table.shape[1], order[-1]
    rows = np.arange(len(starts))
    end = np.tile(np.arange(1, n + 2, dtype=np.int32), (len(starts), 1))
    before = np.tile(np.arange(-1, n, dtype=np.int32), (len(starts), 1))

    def offered(row: np.ndarray, i: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = stop - i
        good = (stop <= n) & (size <= width)
        return np.where(good, order[table[starts[row] + i, np.minimum(size, width) - 1]], worst)

    best = np.full((len(starts), n), worst, np.int32)
    if width > 1:
        for i in range(n - 1):
            best[:, i] = order[table[starts + i, 1]]
    live = rows
    while len(live):
        own = best[live] if len(live) < len(rows) else best
        i = own.argmin(axis=1)
        open_ = own[np.arange(len(live)), i] < worst
        live, i = live[open_], i[open_]
        if not len(live):
            break
        gone = end[live, i]
        stop = end[live, gone]
        end[live, i] = stop
        end[live, gone] = 0
        best[live, gone] = worst
        before[live, stop] = i
        best[live, i] = np.where(stop < n, offered(live, i, end[live, np.minimum(stop, n)]), worst)
        left = before[live, i]
        has = left >= 0
        best[live[has], left[has]] = offered(live[has], left[has], stop[has])
    cell = starts[:, None] + np.arange(n)
    after[cell] = np.where(end[:, :n] > 0, end[:, :n] + starts[:, None], 0)


def encode_units(data: np.ndarray, at: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and the offsets of the units in them. data: units' bytes, at: their n + 1 offsets."""
    n = len(at) - 1
    gapped = np.full(len(data) + n, 0xFF, np.uint8)  # a byte that no piece has, behind each unit
    spot = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))
    gapped[spot] = data
    lead = (gapped & 0xC0) != 0x80
    lead_sum = np.concatenate(([0], np.cumsum(lead)))  # characters before each byte, the gaps counting as one
    chars = int(lead_sum[-1])
    size = np.array([len(t) for t in pieces.texts])
    width = max((len(t.decode()) for t in pieces.texts), default=1)
    table = np.full((chars, width), len(pieces.order) - 1, np.int32)
    for which, place in occurrences(gapped, pieces.texts, pieces.longest):
        start_char = lead_sum[place]
        table[start_char, lead_sum[place + size[which]] - start_char - 1] = pieces.ids[which]
    unit_start = lead_sum[at[:-1] + np.arange(n)]
    unit_size = lead_sum[at[1:] + np.arange(n)] - unit_start
    after = np.zeros(chars + 1, np.int64)
    for k in np.unique(unit_size).tolist():
        own = unit_start[unit_size == k]
        if k > LONG_UNIT:
            for s in own.tolist():
                _heap_units(s, k, table, pieces.order, after)
        elif k:
            for i in range(0, len(own), max(1, CELLS // (k + 1))):
                _table_units(own[i : i + max(1, CELLS // (k + 1))], k, table, pieces.order, after)
    begin = np.flatnonzero(after)
    ids = table[begin, np.minimum(after[begin] - begin, width) - 1]
    unknown = ids == len(pieces.order) - 1
    byte_at = np.flatnonzero(lead)  # first byte of each character
    byte_end = np.append(byte_at[1:], len(gapped))
    count = np.where(unknown, byte_end[begin] - byte_at[begin], 1)
    first = np.cumsum(count) - count
    out = np.repeat(ids, count)
    spread = np.repeat(unknown, count)
    source = np.repeat(byte_at[begin] - first, count) + np.arange(len(out))
    out[spread] = pieces.byte_ids[gapped[source[spread]]]
    edges = np.append(first, len(out))[np.searchsorted(begin, np.append(unit_start, chars))]
    return out, edges


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges [start, start + size) of values, end to end."""
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def encode_texts(data: np.ndarray, at: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n + 1 offsets of the texts in them."""
    size = np.diff(at)
    full = np.flatnonzero(size > 0)  # an empty text has no ids
    wide_at = np.zeros(len(full) + 1, np.int64)
    np.cumsum(size[full] + 1, out=wide_at[1:])
    wide = np.full(int(wide_at[-1]), SPACE, np.uint8)  # the dummy prefix is a space before each text
    wide[np.arange(len(data)) + np.repeat(np.arange(1, len(full) + 1), size[full])] = data
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    space = wide == SPACE
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[wide_at[:-1]] = True
    unit = np.flatnonzero(start)
    unit_end = np.append(unit[1:], len(wide))
    _, chosen, which = np.unique(span_hashes(prefix_sums(wide), unit, unit_end), return_index=True, return_inverse=True)
    own, own_size = unit[chosen], (unit_end - unit)[chosen]
    own_at = np.zeros(len(own) + 1, np.int64)
    np.cumsum(own_size, out=own_at[1:])
    ids, edges = encode_units(gather(wide, own, own_size), own_at, pieces)
    count = np.diff(edges)[which]
    out = gather(ids, edges[:-1][which], count)
    ends = np.concatenate(([0], np.cumsum(count)))
    of_full = ends[np.searchsorted(unit, wide_at)]
    offsets = np.zeros(len(at), np.int64)
    offsets[full + 1] = np.diff(of_full)
    return out, np.cumsum(offsets)


def decode_ids(ids: np.ndarray, at: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and their offsets: pieces joined, without the dummy prefix of each text."""
    flat = np.frombuffer(b"".join(pieces.decoded), np.uint8)
    size = np.array([len(x) for x in pieces.decoded])
    start = np.cumsum(size) - size
    data = gather(flat, start[ids], size[ids])
    edge = np.concatenate(([0], np.cumsum(size[ids])))[at]
    full = np.flatnonzero(np.diff(edge) > 0)
    full = full[data[edge[full]] == SPACE]
    keep = np.ones(len(data), bool)
    keep[edge[full]] = False
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[edge]


@lru_cache(2)
def loaded(model: str) -> Pieces:
    """A model's pieces, once in a worker."""
    return Pieces.load(model)


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids, n_tokens, n_bytes, decoded_sha256, round_trip) for each row: the text's pieces, and what they decode to.

    Null and empty texts have no ids. Repeated rows give repeated rows, an empty table none. Other columns than these two
    are not read. A text is encoded as a whole, whatever its length: a Python worker must hold it some 150 times over.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for rows, data, at in blocks(batches, "text", BATCH_BYTES):
            ids, edges = encode_texts(data, at, pieces)
            back, back_at = decode_ids(ids, edges, pieces)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.array(np.diff(edges)),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(back_at[:-1].tolist(), back_at[1:].tolist(), strict=True)], pa.string()),
                    pa.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(back_at[:-1].tolist(), back_at[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.bool_()),
                ],
                ["id", "ids", "n_tokens", "n_bytes", "decoded_sha256", "round_trip"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(work, f"id {kind}, ids array<int>, n_tokens bigint, n_bytes bigint, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) of rows of ids; null ids are no ids, which decode to an empty text. Bytes that are no UTF-8 become U+FFFD."""
    kind = dict(encoded.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = [np.array(x or [], np.int64) for x in part.column(1).to_pylist()]
                at = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
                data, edge = decode_ids(np.concatenate([np.zeros(0, np.int64), *rows]), at, pieces)
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids).alias("ids")).mapInArrow(work, f"id {kind}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, and whether they decode to its text."""
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id")
