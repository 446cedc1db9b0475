"""Removal of long repeated byte strings by ranks of sampled suffix positions, refined until unique or past the threshold.

Every window of ``length`` bytes contains one of the sampled positions: of the GRAM-byte strings inside the window, the
one with the least hash, the leftmost of equals. Which one it is depends on the window's bytes alone, so equal windows
agree on it. Ranks are names here, as only equality matters: 48 bits for a rank at GRAM bytes, 64 more for a context, and
96 for a window past the threshold.

Round one sorts the sampled positions of the whole corpus by their rank at GRAM bytes; unique ones are done. Round two
pairs the rank with that of the position's whole context, all windows that it stands for: a context that also stands in
a document with a smaller id is removed as it is, and a position whose rank repeats under different contexts goes on.
Round three is past the threshold: the windows themselves, at ``length`` bytes, of those positions only.

Positions travel as compressed arrays, a batch's share of a bucket in one row. A batch sends a context once, with the
smallest id that has it there, so a passage that many documents share reaches its bucket once a batch. A rank that repeats
often in one batch needs no bucket to say so: its positions go on to round three at once, but for the few that tell other
batches. There a group of texts sends a window once. So no bucket gets more of a hot string than a few rows a batch.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OTHER_BYTE, blocks, prefix_sums, read, release, span_hashes, stored, trim

#: Bytes of the sampled strings; at most ``length``.
GRAM = 20
#: Bytes of text for each bucket of ranks, and for each group of texts.
BUCKET_BYTES, GROUP_BYTES = 8 << 20, 8 << 20
#: Bytes of text whose positions leave together, that are packed together, and whose hashes are computed together.
SCAN_BYTES, BATCH_BYTES, TILE_BYTES = 4 << 20, 8 << 20, 1 << 19
_TOP48 = np.uint64(0xFFFF_FFFF_FFFF_0000)
#: Positions of one rank in a batch from which they go on without a bucket's word.
HOT = 64
#: Partitions that one exchange deals into at most; more take two exchanges, so that packed rows do not become tiny.
FAN_OUT = 512
#: Buckets that share a partition at most, where there are more than FAN_OUT: its task parts them, as a second exchange would
#: put everything on disk twice.
SHARED = 64
#: Passes over the windows of round three, each with its share of their names, so that only that share is on disk.
PASSES = 2
#: Bytes of packed rows that the first exchange's tasks put together at a time, and that a task parts by bucket at a time.
REGROUP_BYTES, SPLIT_BYTES = 16 << 20, 8 << 20


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte planes apart."""
    head = ";".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode()
    body = b"".join(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes() for v in arrays.values())
    return head + b"\n" + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    head, _, body = data.partition(b"\n")
    body, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), 0, {}
    for part in head.decode().split(";"):
        name, kind, n = part.split(":")
        size = int(n) * np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(body[at : at + size].reshape(-1, int(n)).T).view(kind).reshape(-1) if int(n) else np.zeros(0, kind)
        at += size
    return out


def sampled(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tile by tile: (text, first window, windows, rank, context) of the sampled positions.

    A position stands for a run of windows, whose starts are relative to their text. A text that spans tiles is cut into
    several runs; each window is in one.
    """
    n_texts = len(at) - 1
    width = length + 1 - gram
    for low in range(0, len(data), TILE_BYTES):
        tile = data[low : low + TILE_BYTES + length - 1]
        if len(tile) < length:
            continue
        sums = prefix_sums(tile)
        start = np.arange(len(tile) - gram + 1)
        rank = span_hashes(sums, start, start + gram)
        least = (rank >> np.uint64(22) << np.uint64(22)) | start.astype(np.uint64)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        place = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        window = np.arange(len(place))
        edges = np.clip(at - low, 0, len(place))
        text = np.repeat(np.arange(n_texts), np.diff(edges))
        keep = window[: len(text)] + low + length <= at[text + 1]
        window, place, text = window[: len(text)][keep], place[: len(text)][keep], text[keep]
        if not len(window):
            continue
        fresh = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
        first, last = window[fresh], window[np.append(fresh[1:] - 1, len(window) - 1)]
        yield text[fresh], first + low - at[text[fresh]], last - first + 1, rank[place[fresh]], span_hashes(sums, first, last + length)


def least_by(keys: tuple[np.ndarray, ...], value: np.ndarray) -> np.ndarray:
    """For each row the least value among the rows with the same keys. Rows are sorted by the first key, which alone tells nearly all apart."""
    if not len(value):
        return value
    order = np.argsort(keys[0])
    if len(keys) > 1 and _mixes(keys, order):
        order = np.lexsort(keys[::-1])
    first = np.flatnonzero(_fresh(keys, order))
    out = np.empty_like(value)
    out[order] = np.repeat(np.minimum.reduceat(value[order], first), np.diff(np.append(first, len(value))))
    return out


def _fresh(keys: tuple[np.ndarray, ...], order: np.ndarray) -> np.ndarray:
    """Which rows, in this order, differ from the one before in any key."""
    out = np.zeros(len(order), bool)
    out[:1] = True
    for key in keys:
        ordered = key[order]
        out[1:] |= ordered[1:] != ordered[:-1]
    return out


def _mixes(keys: tuple[np.ndarray, ...], order: np.ndarray) -> bool:
    """Whether rows that agree in the first key differ in another."""
    return int(_fresh(keys, order).sum()) != int(_fresh(keys[:1], order).sum())


#: Columns of a text, which its positions share.
TEXT_COLUMNS = ("id", "row", "group")


def dealt(part: np.ndarray, **arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A packed string of the rows of each part."""
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    edges = np.append(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(part) else [], len(part)).astype(np.int64)
    text_of = [k for k in TEXT_COLUMNS if k in arrays]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = order[a:b]
        # What a text has in common stands once.
        _, first, place = np.unique(arrays["row"][own], return_index=True, return_inverse=True)
        table = {k: arrays[k][own[first]] for k in text_of}
        yield int(ordered[a]), pack(**table, place=place.astype(np.uint32), **{k: v[own] for k, v in arrays.items() if k not in table})


def rows_of(parts: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for p, data in parts:
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])


def joined(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The packed strings' arrays, end to end."""
    found = []
    for blob in blobs:
        x = unpack(blob)
        place = x.pop("place")
        found.append({k: v[place] if k in TEXT_COLUMNS else v for k, v in x.items()})
    return {k: np.concatenate([x[k] for x in found]) for k in found[0]} if found else {}


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of a part put together, some bytes at a time."""
    held: dict[int, list[bytes]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for part, blobs in held.items():
            x = joined(blobs)
            yield from rows_of(dealt(np.full(len(x["row"]), part, np.int64), **x))

    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(part, []).append(data)
            size += len(data)
            if size > REGROUP_BYTES:
                yield from given()
                held, size = {}, 0
    yield from given()


def to_buckets(packed: DataFrame, n: int, fan_out: int | None = None) -> DataFrame:
    """Packed rows (part, data), each part in the partition of its number."""
    per = fan_out or FAN_OUT
    if n > per:
        wide = -(-n // per)
        packed = packed.repartitionById(-(-n // wide), F.expr(f"cast(floor(part / {wide}) as int)")).mapInArrow(_regrouped, "part int, data binary")
    return packed.repartitionById(n, F.col("part"))


#: How a position stands when it leaves its batch: a bucket decides; removed; goes on to round three.
ASKS, REMOVED, GOES_ON = 0, 1, 2


def bucket_of(x: dict[str, np.ndarray], key: str, n_buckets: int) -> np.ndarray:
    """The bucket of each row: by its name if that is still to be decided, else any."""
    return (np.where(x["state"] != ASKS, x["row"].view(np.uint64), x[key] >> np.uint64(16)) % np.uint64(n_buckets)).astype(np.int64)


def by_bucket(batches: Iterator[pa.RecordBatch], key: str, n_buckets: int, wide: int) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a partition, one bucket after the other. Where it holds several, they wait in a file of the task's own, and one is in memory."""
    blobs = (data for batch in batches for data in batch.column(1).to_pylist())
    if wide == 1:
        whole = [joined(list(blobs))]
        if whole[0]:
            yield whole.pop()  # not kept here, so that it can go
        return
    with tempfile.TemporaryFile() as file:
        places: dict[int, list[tuple[int, int]]] = {}

        def put(held: list[bytes]) -> None:
            x = joined(held)
            for b, data in dealt(bucket_of(x, key, n_buckets), **x) if x else ():
                places.setdefault(b, []).append((file.tell(), len(data)))
                file.write(data)

        held, size = [], 0
        for data in blobs:
            held.append(data)
            size += len(data)
            if size > SPLIT_BYTES:
                put(held)
                held, size = [], 0
        put(held)
        del held
        for b in sorted(places):
            own = []
            for at, n in places[b]:
                file.seek(at)
                own.append(file.read(n))
            yield joined(own)


def _hot(rank: np.ndarray, context: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """Positions whose rank stands here over HOT times, under several contexts and ids, but for those with the least and greatest of both."""
    out = np.zeros(len(rank), bool)
    if not len(rank):
        return out
    order = np.argsort(rank)
    edge = np.flatnonzero(_fresh((rank,), order))
    many = np.flatnonzero(np.diff(np.append(edge, len(order))) > HOT)
    for a, b in zip(edge[many].tolist(), np.append(edge, len(order))[many + 1].tolist(), strict=True):
        own = order[a:b]
        i, c = ident[own], context[own]
        if i.min() != i.max() and c.min() != c.max():
            out[own] = True
            out[own[[i.argmin(), i.argmax(), c.argmin(), c.argmax()]]] = False
    return out


def _scan(length: int, gram: int, n_buckets: int, wide: int = 1):
    """Rows (id, row, part, text) to packed positions by bucket of their rank, ``wide`` buckets together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text", SCAN_BYTES):
            ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, group = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            found = list(sampled(data, at, length, gram))
            if not found:
                continue
            text, first, count, rank, context = (np.concatenate(x) for x in zip(*found, strict=True))
            rank, ident = rank & _TOP48, ids[text]
            state = np.zeros(len(rank), np.uint8)
            state[ident > least_by((context, rank), ident)] = REMOVED  # the context stands in this batch with a smaller id
            asks = np.flatnonzero(state == ASKS)
            state[asks[_hot(rank[asks], context[asks], ident[asks])]] = GOES_ON
            # What is decided only passes through, by any bucket: a hot rank sends its bucket no more than a few rows a batch.
            rank[state != ASKS] = context[state != ASKS] = 0
            x = {"rank": rank, "context": context, "id": ident, "row": row[text], "group": group[text], "first": first.astype(np.uint32), "count": count.astype(np.uint16), "state": state}
            yield from rows_of(dealt(bucket_of(x, "rank", n_buckets) // wide, **x))

    return work


def _rank(batches: Iterator[pa.RecordBatch], n_buckets: int = 1, wide: int = 1) -> Iterator[pa.RecordBatch]:
    """Rounds one and two in a bucket. Gives, by group of texts: runs of windows to remove (open 0), or to look at one by one (open 1)."""
    for x in by_bucket(batches, "rank", n_buckets, wide):
        remove, go_on = x["state"] == REMOVED, x["state"] == GOES_ON
        asks = np.flatnonzero(x["state"] == ASKS)
        if len(asks):
            rank, context, ident = x["rank"][asks], x["context"][asks], x["id"][asks]
            own = ident > least_by((context, rank), ident)
            remove[asks] = own
            # The first rows of each context; a rank that several contexts and ids share goes on with them.
            order = np.argsort(rank)
            edge = np.flatnonzero(_fresh((rank,), order))
            several = np.ones(len(edge), bool)
            for value in (context[order], ident[order]):
                several &= np.minimum.reduceat(value, edge) != np.maximum.reduceat(value, edge)
            whole = np.empty(len(order), bool)
            whole[order] = np.repeat(several, np.diff(np.append(edge, len(order))))
            go_on[asks] = whole & ~own
        keep = remove | go_on
        yield from rows_of(dealt(x["group"][keep], row=x["row"][keep], id=x["id"][keep], first=x["first"][keep], count=x["count"][keep], open=go_on[keep].astype(np.uint8)))
        del x
        trim()


def texts_of(table: pa.Table) -> Iterator[tuple[int | None, int, bytes]]:
    """(id, row, text) of packed texts."""
    for data in table["data"].to_pylist():
        head, _, body = data.partition(b"\n")
        n = int(head)
        raw = zstandard.ZstdDecompressor().decompress(body)
        ids, known, row, size = (np.frombuffer(raw, np.int64, n, k * 8 * n) for k in range(4))
        at = 32 * n
        for i, k, r, s in zip(ids.tolist(), known.tolist(), row.tolist(), size.tolist(), strict=True):
            yield i if k else None, r, raw[at : at + s]
            at += s


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, row, part, text) to one compressed string for each group of texts in a batch."""
    for rows, data, at in blocks(batches, "text", BATCH_BYTES):
        ids = rows.column(0)
        known = np.array(ids.is_valid().to_numpy(zero_copy_only=False), np.int64)
        ident = ids.fill_null(0).to_numpy().astype(np.int64)
        row, group = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        for p in np.unique(group).tolist():
            own = np.flatnonzero(group == p)
            size = np.diff(at)[own]
            body = b"".join([ident[own].tobytes(), known[own].tobytes(), row[own].tobytes(), size.tobytes(), *(data[at[i] : at[i + 1]].tobytes() for i in own.tolist())])
            packed = b"%d\n" % len(own) + zstandard.ZstdCompressor(level=3).compress(body)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed], pa.binary())], ["part", "data"])


def window_names(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of windows: 64 bits, and 32 more of an independent hash."""
    return span_hashes(prefix_sums(data), start, start + length), (span_hashes(prefix_sums(data, OTHER_BYTE), start, start + length) >> np.uint64(32)).astype(np.uint32)


def _windows(length: int, n_buckets: int, wide: int = 1, passes: int = 1, turn: int = 0):
    """A group's texts and open runs to packed windows by bucket of their name, those of this turn. A window goes once, with the smallest id that has it in the group."""

    def work(texts: pa.Table, runs: pa.Table) -> pa.Table:
        x = joined(runs["data"].to_pylist())
        out: list[tuple[int, bytes]] = []
        if x and (x["open"] == 1).any():
            keep = x["open"] == 1
            order = np.argsort(x["row"][keep], kind="stable")
            row, first, count = (x[k][keep][order] for k in ("row", "first", "count"))
            wanted = set(row.tolist())
            seen: set[tuple[int, int]] = set()
            found: list[tuple[np.ndarray, ...]] = []
            for i, r, text in texts_of(texts):
                if r not in wanted or (i, r) in seen:
                    continue
                seen.add((i, r))
                a, b = np.searchsorted(row, r), np.searchsorted(row, r, "right")
                f, c = first[a:b].astype(np.int64), count[a:b].astype(np.int64)
                start = np.unique(np.repeat(f - (np.cumsum(c) - c), c) + np.arange(int(c.sum())))
                whole = np.frombuffer(text, np.uint8)
                for low in range(0, len(whole), TILE_BYTES):
                    own = start[(start >= low) & (start < low + TILE_BYTES) & (start + length <= len(whole))]
                    if len(own):
                        h, check = window_names(whole[low : low + TILE_BYTES + length], own - low, length)
                        now = h % np.uint64(passes) == turn
                        n = int(now.sum())
                        found.append((h[now], check[now], np.full(n, i, np.int64), np.full(n, r, np.int64), own[now].astype(np.uint32)))
            if found:
                h, check, ident, row, start = (np.concatenate(v) for v in zip(*found, strict=True))
                done = ident > least_by((h, check), ident)
                h[done] = check[done] = 0
                p = np.full(len(h), texts["part"][0].as_py(), np.int32)
                order = np.argsort(h)
                x = {"hash": h[order], "check": check[order], "id": ident[order], "row": row[order], "group": p[order], "first": start[order], "state": done[order].astype(np.uint8)}
                out = list(dealt(bucket_of(x, "hash", n_buckets) // wide, **x))
        trim()
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    return work


def _past_threshold(batches: Iterator[pa.RecordBatch], n_buckets: int = 1, wide: int = 1) -> Iterator[pa.RecordBatch]:
    """Round three in a bucket: windows that a smaller id has, by group of texts."""
    for x in by_bucket(batches, "hash", n_buckets, wide):
        keep = x["state"] == REMOVED
        asks = np.flatnonzero(~keep)
        keep[asks] = x["id"][asks] > least_by((x["hash"][asks], x["check"][asks]), x["id"][asks])
        n = int(keep.sum())
        yield from rows_of(dealt(x["group"][keep], id=x["id"][keep], row=x["row"][keep], first=x["first"][keep], count=np.ones(n, np.uint16), open=np.zeros(n, np.uint8)))
        del x, keep
        trim()


FOUND = "id bigint, text_bytes binary, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>"


def covered(first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that runs of windows cover."""
    if not len(first):
        return first, first
    order = np.argsort(first, kind="stable")
    start, reach = first[order], np.maximum.accumulate(first[order] + count[order] + length - 1)
    fresh = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)]


def _kept(length: int, emit):
    """A group's texts and runs to result rows."""

    def work(texts: pa.Table, runs: pa.Table) -> list:
        x = joined(runs["data"].to_pylist())
        if x:
            keep = x["open"] == 0
            order = np.argsort(x["row"][keep], kind="stable")
            row, ident, first, count = (x[k][keep][order] for k in ("row", "id", "first", "count"))
        else:
            row = ident = first = count = np.zeros(0, np.int64)
        out = []
        for i, r, text in texts_of(texts):
            own = slice(int(np.searchsorted(row, r)), int(np.searchsorted(row, r, "right")))
            mine = ident[own] == i if i is not None else np.zeros(own.stop - own.start, bool)
            start, end = covered(first[own][mine].astype(np.int64), count[own][mine].astype(np.int64), length)
            out.append(emit(i, r, text, start.tolist(), end.tolist()))
        trim()
        return out

    return work


def _plan(docs: DataFrame, id_col: str, text: str, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(texts, runs), both by part: the packed texts, and the packed runs of windows to remove of each group."""
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("ids must be integers")
    total = docs.select(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    n_buckets, groups = max(8, -(-total // BUCKET_BYTES)), max(8, -(-total // GROUP_BYTES))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text).cast("string")).alias("row"), F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text).cast("string"), F.lit(3)), F.lit(groups)).cast("int").alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    packed = "part int, data binary"
    wide = min(SHARED, -(-n_buckets // FAN_OUT))
    parts, passes = -(-n_buckets // wide), PASSES if n_buckets > 8 else 1
    positions = source.where("id is not null").mapInArrow(_scan(length, gram, n_buckets, wide), packed)
    ranked = stored(to_buckets(positions, parts).mapInArrow(lambda batches: _rank(batches, n_buckets, wide), packed))
    release(docs.sparkSession)
    texts, runs = source.mapInArrow(packed_texts, packed), ranked
    for turn in range(passes):
        windows = texts.groupBy("part").cogroup(ranked.groupBy("part")).applyInArrow(_windows(length, n_buckets, wide, passes, turn), packed)
        runs = runs.unionByName(stored(to_buckets(windows, parts).mapInArrow(lambda batches: _past_threshold(batches, n_buckets, wide), packed)))
        release(docs.sparkSession)
    return texts, runs


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) for each row of ``docs``.

    spans: maximal runs, in UTF-8 bytes, of what strings of ``length`` bytes cover that also start in a row with a
    smaller id. Rows with the same id never take from each other; repeated rows have the same result each. A row
    without an id neither loses bytes nor makes others lose any. Null and empty texts are empty. Matches do not cross
    rows and are judged on the texts as they came. Other columns than these two are not read. An empty table gives no
    rows. A text must fit in a Python worker's memory some thirty times over, whatever its length.
    """
    texts, runs = _plan(docs, id_col, text, length, gram)

    def emit(i, r, data, start, end):
        digest, at = hashlib.sha256(), 0
        for a, b in zip(start, end, strict=True):
            digest.update(data[at:a])
            at = b
        digest.update(data[at:])
        return i, len(data), sum(end) - sum(start), [{"start": a, "end": b} for a, b in zip(start, end, strict=True)], digest.hexdigest()

    kept = _kept(length, emit)
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = kept(left, right)
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return texts.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(work, "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def whole_characters(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without characters that it holds only in part."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated spans taken out of ``text``, whole characters only; other columns and rows stay.

    Null texts stay null; empty texts, ties, repeated rows, rows without an id, very long texts and empty tables are as in
    repeated_spans(). Other columns may have any names.
    """
    texts, runs = _plan(docs, id_col, text, length, gram)

    def emit(i, r, data, start, end):
        out, at = [], 0
        for a, b in zip(start, end, strict=True):
            a, b = whole_characters(data, a, b)
            out.append(data[at:a])
            at = b
        out.append(data[at:])
        return i, r, b"".join(out).decode("utf-8", "replace")

    kept = _kept(length, emit)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list({(i, r): t for i, r, t in kept(left, right)}.items())
        return pa.table({"id": pa.array([i for (i, _), _ in rows], pa.int64()), "row": pa.array([r for (_, r), _ in rows], pa.int64()), "kept": pa.array([t for _, t in rows], pa.string())})

    clean = texts.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(work, "id bigint, row bigint, kept string").select(F.col("id").alias("of"), "row", "kept")
    ident = F.col(id_col).cast("long")
    # The text itself stays out of this join: its row is found by id and hash.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    keyed = docs.select(others.alias("record"), F.col(text).isNotNull().alias("stated"), ident.alias("id"), F.xxhash64(ident, F.col(text).cast("string")).alias("hash"))
    whole = keyed.join(clean, (F.col("hash") == F.col("row")) & F.col("id").eqNullSafe(F.col("of")))
    return whole.select(*[F.when(F.col("stated"), F.col("kept")).alias(c) if c == text else F.col("record")[c].alias(c) for c in docs.columns])


#: Bytes that the first ranks of doubled_windows() compare, and bits of a place inside a text.
FIRST_BYTES, PLACE_BITS = 8, 24


def doubled_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(id, at): starts of windows that a text with a smaller id has too, by prefix doubling over every position.

    Spark sorts positions by their ranks at some length and at that distance further on; equal pairs get one new rank, the
    least position of theirs, and what stands in one text alone leaves, until ranks are ``length`` bytes long. No hashes.
    It moves every position in every round: README has figures, and why repeated_spans() samples positions instead. For
    unique ids from 0 and texts under 16 MB; ``length`` must be FIRST_BYTES or more. Null and empty texts have no windows.
    """
    spark = docs.sparkSession
    ident = F.col(id_col).cast("long")
    data = docs.select(ident.alias("id"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("data"))
    places = F.sequence(F.lit(0), F.octet_length("data") - FIRST_BYTES)
    pairs = data.where(F.octet_length("data") >= length).select("id", "data", F.explode(places).alias("at")).select("id", "at", F.substring("data", F.col("at") + 1, FIRST_BYTES).alias("here"), F.lit(0).cast("long").alias("there"))

    def ranked(pairs: DataFrame) -> DataFrame:
        same = Window.partitionBy("here", "there")
        own = pairs.withColumn("rank", F.min(F.shiftleft("id", PLACE_BITS) + F.col("at")).over(same))
        several = own.withColumn("several", F.min("id").over(same) < F.max("id").over(same)).where("several")
        return stored(several.select("id", "at", "rank"))

    ranks, width = ranked(pairs), FIRST_BYTES
    while width < length:
        step = min(width, length - width)
        ahead = ranks.select("id", (F.col("at") - step).alias("at"), F.col("rank").alias("there"))
        ranks, width = ranked(ranks.withColumnRenamed("rank", "here").join(ahead, ["id", "at"])), width + step
        release(spark)
    return ranks.where(F.shiftright("rank", PLACE_BITS) < F.col("id")).select("id", "at")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when 50-byte strings of documents with smaller ids are removed."""
    out = repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP1_SQL = """
WITH sized AS (SELECT doc_id, encode(coalesce(text, '')) AS b8, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, i, b8[i : i + 49] AS w FROM (SELECT doc_id, b8, unnest(range(1, n - 48)) AS i FROM sized WHERE n >= 50)),
least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING count(*) > 1),
starts AS (SELECT windows.doc_id, i FROM windows JOIN least USING (w) WHERE windows.doc_id > first),
runs AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM starts),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM runs) GROUP BY doc_id, k),
gaps AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since FROM spans
    UNION ALL SELECT sized.doc_id, n + 1, n + 1, coalesce(last, 1) FROM sized LEFT JOIN (SELECT doc_id, max(b) AS last FROM spans GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(CASE WHEN a > since THEN hex(b8[since : a - 1]) ELSE '' END, '' ORDER BY a, b) AS k FROM gaps JOIN sized USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM sized JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
