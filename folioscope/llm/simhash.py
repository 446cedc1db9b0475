"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index for links, and components of linked documents.

Links are searched between distinct fingerprints, so copies cost nothing. The 64 bits are cut into blocks; two
fingerprints that differ in few bits agree in most blocks, so each is sent once to a group for every choice of agreeing
blocks. In a group the fingerprints are sorted by Gray rank, and each run of one leading bit pattern becomes a node that
holds that pattern once. Pairs of nodes are compared from the top: the differing bits of the patterns add up, and a pair
of nodes over the limit is dropped with everything below it. A group gives a spanning forest of its links, never all
pairs; star contraction joins the forests of all groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read, release, stored, trim

#: Words that a text is cut into at a time; a longer text takes no more memory than this many.
WORDS_AT_ONCE = 1 << 16
#: Bytes of text that are split at a time.
SPLIT_BYTES = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time."""
    at = 0
    while at < len(data):
        end = at + SPLIT_BYTES
        if end < len(data):
            near = max(data.rfind(bytes([c]), at, end) for c in _SPACE)
            if near <= at:  # a very long word
                found = [x for c in _SPACE if (x := data.find(bytes([c]), end)) >= 0]
                near = min(found, default=len(data))
            end = near
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included. Null and a text without words: zero."""
    if not text:
        return 0
    hash_of = xxhash.xxh64_intdigest
    ones, total, kept, whole = np.zeros(64, np.int64), 0, [], 0
    for words in _word_runs(text.encode("utf-8", "surrogatepass").lower()):
        whole += len(words)
        kept += words
        if len(kept) < shingle:
            continue
        line = b" ".join(kept)
        size = np.fromiter(map(len, kept), np.int64, len(kept))
        end = np.cumsum(size + 1) - 1
        start = (end - size).tolist()
        end = end.tolist()
        hashes = np.array([hash_of(line[a:b], seed) for a, b in zip(start, end[shingle - 1 :], strict=False)], np.uint64)
        for i in range(0, len(hashes), WORDS_AT_ONCE):
            ones += np.unpackbits(hashes[i : i + WORDS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        kept = kept[len(kept) - shingle + 1 :] if shingle > 1 else []
    if not whole:
        return 0
    if not total:  # fewer words than a shingle
        return hash_of(b" ".join(kept), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the signed 64-bit form of each row's fingerprint, one row for each row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out = np.fromiter((fingerprint(x, shingle, seed) for x in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(work, f"id {kind}, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank of each code in the Gray order: the running XOR of its bits from the top."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


#: Bits of a node's pattern, from the leading ones down.
LEVEL_BITS = (8, 8, 8, 8, 8, 8, 8, 8)
#: Node pairs that are compared at a time.
PAIRS_AT_ONCE = 1 << 20


def _expand(first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of the children of each pair of nodes: (index of the pair, child of a, child of b)."""
    n = n_a * n_b
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, first_a[which] + k // n_b[which], first_b[which] + k % n_b[which]


def linked_pairs(fps: np.ndarray, limit: int, fixed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of distinct fingerprints that differ in 1 to ``limit`` bits and agree in their top ``fixed`` bits.

    The hierarchical index: fingerprints in Gray order, a node for each run of a shared leading pattern, and the
    descent over pairs of nodes with the differing bits added up.
    """
    order = np.argsort(gray_rank(fps), kind="stable")
    x = fps[order]
    # Level by level: node starts among the fingerprints, the pattern of the level's bits, and the first child of each.
    starts, patterns, depth = [], [], 0
    for bits in LEVEL_BITS:
        depth += bits
        top = x >> np.uint64(64 - depth)
        at = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        starts.append(at)
        patterns.append((top[at] & np.uint64((1 << bits) - 1)).astype(np.uint8))
    depths = np.cumsum(LEVEL_BITS)
    children = [np.searchsorted(starts[k + 1], np.append(starts[k], len(x))) for k in range(len(starts) - 1)]

    def below(level: int, a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == len(LEVEL_BITS) - 1:
            hit = a < b
            yield order[starts[level][a[hit]]], order[starts[level][b[hit]]]
            return
        first = children[level]
        n = (first[a + 1] - first[a]) * (first[b + 1] - first[b])
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS_AT_ONCE)) + 1
        for part in np.split(np.arange(len(a)), cuts):
            pa_, pb = a[part], b[part]
            which, ca, cb = _expand(first[pa_], first[pa_ + 1] - first[pa_], first[pb], first[pb + 1] - first[pb])
            total = gap[part][which] + np.bitwise_count(patterns[level + 1][ca] ^ patterns[level + 1][cb])
            keep = (total <= (0 if depths[level + 1] <= fixed else limit)) & (ca <= cb)
            if keep.any():
                yield from below(level + 1, ca[keep], cb[keep], total[keep])

    # Roots: runs of equal top ``fixed`` bits; the descent starts with pairs of level-0 nodes inside a run.
    group = x[starts[0]] >> np.uint64(64 - fixed) if 0 < fixed <= LEVEL_BITS[0] else np.zeros(len(starts[0]), np.uint64)
    edge = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group))
    size = np.diff(edge)
    _, a, b = _expand(edge[:-1], size, edge[:-1], size)
    if fixed >= LEVEL_BITS[0]:
        a = b = np.arange(len(starts[0]))
    gap = np.bitwise_count(patterns[0][a] ^ patterns[0][b]).astype(np.int64)
    keep = (gap <= limit) & (a <= b)
    yield from below(0, a[keep], b[keep], gap[keep])


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the given links."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            i, j = label[i], label[j]
            open_ = i != j
            i, j = np.minimum(i, j)[open_], np.maximum(i, j)[open_]
            np.minimum.at(label, j, i)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def block_choices(limit: int, blocks: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of ``blocks - limit`` agreeing blocks: the number of agreeing bits, and (shift, bits) of all blocks with the agreeing first."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    spans = [(edges[k], edges[k + 1] - edges[k]) for k in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - limit):
        order = [*chosen, *(k for k in range(blocks) if k not in chosen)]
        out.append((sum(spans[k][1] for k in chosen), [spans[k] for k in order]))
    return out


def rearranged(fps: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with the given bit blocks in the given order, the first on top."""
    out = np.zeros(len(fps), np.uint64)
    for shift, bits in spans:
        out = (out << np.uint64(bits)) | ((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
    return out


def link_forest(distinct: DataFrame, limit: int = 2, blocks: int | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column fp that connect all that differ in at most ``limit`` bits.

    blocks: into how many blocks the bits are cut; the more fingerprints, the more, so that groups stay small.
    """
    if blocks is None:
        n = distinct.count()
        blocks = limit + (1 if n < 1 << 24 else 2 if n < 1 << 30 else 3)
    choices = block_choices(limit, blocks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        which, fps = table["choice"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        for k in np.unique(which):
            own = fps[which == k]
            agreeing, spans = choices[k]
            label = forest(len(own), linked_pairs(rearranged(own, spans), limit, agreeing))
            held = np.flatnonzero(label != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[held].view(np.int64)), pa.array(own[label[held]].view(np.int64))], ["a", "b"])

    keys = []
    for k, (_, spans) in enumerate(choices):
        chosen = spans[: blocks - limit]
        parts = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift, bits in chosen]
        keys.append(F.struct(F.lit(k).alias("choice"), F.xxhash64(F.lit(k), *parts).alias("key")))
    spread = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.choice", "k.key")
    count = max(8, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.repartition(count, "key").mapInArrow(work, "a bigint, b bigint")


def star_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the links (a, b), by large-star and small-star rounds.

    Self links and repeated links are allowed. Every round is kept in the shared folder; the driver sees two sums.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``: its fingerprint and the smallest id that it is linked to.

    Rows link when their fingerprints differ in at most ``limit`` bits, over any number of steps. Null and texts
    without words have fingerprint zero and link like any other. Repeated rows give repeated rows. A null id is never
    the smallest, unless its component has no other. An empty table gives no rows. Extra columns are not read.
    """
    kept = cut(fingerprints(docs, id_col, text, shingle, seed))
    distinct = cut(kept.groupBy("fp").agg(F.min("id").alias("least")))
    roots = star_components(link_forest(distinct.select("fp"), limit))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return kept.join(of_fp, "fp").select("id", "fp", "component_id")


#: Candidates for a similarity: minima of so many hashes make a band, and so many bands are tried. Two texts at 0.8 share no band once in 14 000 times.
BAND_ROWS, BANDS = 5, 24
#: Bits that a SimHash candidate differs in at most, besides the bands.
NEAR_BITS = 3
#: Texts whose sets are made at a time.
ROWS_AT_ONCE = 128
#: Shingles whose minima are taken at a time.
SHINGLES_AT_ONCE = 4096
_MIX = np.random.default_rng(20_240_502).integers(1, 1 << 63, (2, BAND_ROWS * BANDS), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, repeats included, some at a time. All words, if they are fewer than a shingle."""
    kept, whole, given = [], 0, False
    for words in _word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        whole += len(words)
        kept += words
        if len(kept) >= shingle:
            line = b" ".join(kept)
            size = np.fromiter(map(len, kept), np.int64, len(kept))
            end = np.cumsum(size + 1) - 1
            pairs = zip((end - size).tolist(), end[shingle - 1 :].tolist(), strict=False)
            yield np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in pairs], np.uint64)
            given = True
            kept = kept[len(kept) - shingle + 1 :] if shingle > 1 else []
    if whole and not given:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), seed)], np.uint64)


def shingle_set(text: str | None, shingle: int, seed: int = 42) -> tuple[np.ndarray, int]:
    """The distinct shingles of a text, sorted, and its SimHash."""
    ones, total, found = np.zeros(64, np.int64), 0, [np.zeros(0, np.uint64)]
    for hashes in shingle_hashes(text, shingle, seed):
        for i in range(0, len(hashes), WORDS_AT_ONCE):
            ones += np.unpackbits(hashes[i : i + WORDS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        found.append(np.unique(hashes))
    return np.unique(np.concatenate(found)), int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def bands_of(shingles: np.ndarray) -> list[int]:
    """A signed hash of each band's minima; two sets share a band with the probability of their similarity to the power BAND_ROWS."""
    least = np.full(BAND_ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), SHINGLES_AT_ONCE):
            mixed = (shingles[i : i + SHINGLES_AT_ONCE, None] ^ _MIX[0]) * _MIX[1]
            np.minimum(least, mixed.min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _set_key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def similarities(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Shared shingles over all shingles, of one sorted set with each of the others."""
    size = np.array([len(x) for x in others])
    if not len(one) or not size.all():
        return np.array([float(len(x) == len(one)) for x in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
    return shared / (len(one) + size - shared)


#: Bytes of sets that meet as many others in one task.
BLOCK_SETS = 4 << 20


def _linked(least: float):
    """Rows (a, b, data, other) to the links between sets that are at least so similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                one, other = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                hit[i] = similarities(one, [other])[0] >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit))
            trim()

    return work


def _met(least: float):
    """Two blocks (label, data) of a bucket to the links between the labels of sets that are at least so similar."""

    def work(few: pa.Table, others: pa.Table) -> pa.Table:
        label = others["label"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in others["data"]]
        found: set[tuple[int, int]] = set()
        for own, data in zip(few["label"].to_pylist(), few["data"], strict=True):
            known = [b for a, b in found if a == own] + [own]
            rest = np.flatnonzero(~np.isin(label, known))
            if len(rest):
                near = rest[similarities(np.frombuffer(data.as_buffer(), np.uint64), [sets[k] for k in rest.tolist()]) >= least]
                found |= {(own, b) for b in np.unique(label[near]).tolist()}
        links = sorted(found)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return work


def linked_in_buckets(members: DataFrame, sets: DataFrame, least: float, block_bytes: int = BLOCK_SETS) -> DataFrame:
    """(key, first): the least key that each key is linked to. Sets (key, data) link if they share a bucket (bucket, key) and are at least so similar.

    First every set meets the least key of its buckets, which joins all near copies of one text at a cost that grows as
    their number. Then in each bucket all sets outside of its largest component meet all sets of the bucket, in blocks of
    bounded size, so that no task gets a whole bucket and no pair of components is left out.
    """
    low = members.groupBy("bucket").agg(F.min("key").alias("low"))
    pairs = members.join(low, "bucket").where("key <> low").select("key", "low").distinct()
    with_both = pairs.join(sets, "key").join(sets.select(F.col("key").alias("low"), F.col("data").alias("other")), "low")
    links = with_both.select(F.col("key").alias("a"), F.col("low").alias("b"), "data", "other").mapInArrow(_linked(least), "a bigint, b bigint")
    roots = star_components(links).withColumnRenamed("node", "key")
    labelled = cut(members.join(roots, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("label")))
    release(members.sparkSession)

    sizes = labelled.join(sets.select("key", F.octet_length("data").alias("size")), "key")
    parts = sizes.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "label", "size"))
    shape = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum("size").alias("size"), most.alias("most")).where("labels > 1")
    blocks = lambda x: F.greatest(F.ceil(x / block_bytes), F.lit(1)).cast("int")
    open_ = cut(labelled.join(shape.select("bucket", F.col("most")["label"].alias("most"), blocks(F.col("size") - F.col("most")["size"]).alias("na"), blocks(F.col("size")).alias("nb")), "bucket"))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = [F.col(c).alias(c) for c in ("bucket", "i", "j", "label", "data")]  # columns of its own for each side
    few = open_.where("label <> most").select("bucket", "key", "label", place("na").alias("i"), every("nb").alias("j")).join(sets, "key").select(*own)
    others = open_.select("bucket", "key", "label", place("nb").alias("j"), every("na").alias("i")).join(sets, "key").select(*own)
    more = few.groupBy("bucket", "i", "j").cogroup(others.groupBy("bucket", "i", "j")).applyInArrow(lambda a, b: _met(least)(a, b), "a bigint, b bigint")
    again = star_components(more)
    labels = labelled.select("key", "label").distinct()
    return labels.join(again.withColumnRenamed("node", "label"), "label", "left").select("key", F.coalesce("root", "label").alias("first"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.8, shingle: int = 5, seed: int = 42, block_bytes: int = BLOCK_SETS) -> DataFrame:
    """(id, component_id) for each row of ``docs``: the smallest id that it is linked to.

    Rows link when their sets of word shingles have a similarity (shared over all) of ``least`` or more, over any number
    of steps; null, empty and other texts without words are all alike. Candidates share a band of minima, or are linked in
    the Gray-order index of SimHash fingerprints; every link is then verified on the sets. A null id is never the smallest,
    unless its component has no other. Repeated rows give repeated rows, an empty table none; other columns are not read.
    A text must fit in a Python worker's memory some twenty times over, whatever its length; a group of copies need not.
    """
    kind, spark = dict(docs.dtypes)[id_col], docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                found = [(_set_key(x), np.uint64(fp).view(np.int64), bands_of(x)) for x, fp in (shingle_set(t, shingle, seed) for t in part.column(1).to_pylist())]
                key, fp, bands = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "key", "fp", "bands"])
                trim()

    kept = stored(rows.mapInArrow(sketch, f"id {kind}, key bigint, fp bigint, bands array<bigint>"))
    # Rows with the same set of shingles are one node.
    nodes = kept.groupBy("key").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    roots = star_components(link_forest(kept.select("fp").distinct(), NEAR_BITS)).withColumnRenamed("node", "fp")
    near = F.xxhash64(F.coalesce("root", "fp"), F.lit(BANDS))
    nodes = stored(nodes.join(roots, "fp", "left").select("key", "least", F.concat("bands", F.array(near)).alias("bands")))
    release(spark)
    spread = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("bucket")
    members = stored(spread.join(shared, "bucket").select("bucket", "key"))
    release(spark)
    wanted = nodes.select("key", F.col("least").alias("__least")).join(members.select("key").distinct(), "key")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                found = [shingle_set(t, shingle, seed)[0] for t in part.column(1).to_pylist()]
                own = pa.array([_set_key(x) == k for x, k in zip(found, part.column(0).to_pylist(), strict=True)])  # an id may stand in other rows too
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "data"]).filter(own)
                trim()

    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("__least"))).select("key", "text")
    sets = stored(texts.mapInArrow(shingled, "key bigint, data binary").dropDuplicates(["key"]))
    del texts
    release(spark)
    firsts = cut(nodes.select("key", "least").join(linked_in_buckets(members, sets, least, block_bytes), "key", "left").select("key", "least", F.coalesce("first", "key").alias("first")))
    release(spark)
    components = firsts.groupBy("first").agg(F.min("least").alias("component_id"))
    return kept.select("id", "key").join(firsts.join(components, "first").select("key", "component_id"), "key").select("id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", groups: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id; of rows that repeat it, one.

    groups: gives each row's component; it says what becomes of nulls, empty and very long texts and empty tables. Columns
    stay as they are, whatever their names.
    """
    key = lambda c: F.struct(F.col(c).alias("id"))  # noqa: E731  (null ids are equal inside a struct)
    found = groups(docs, id_col, text, **options).where(F.col("id").eqNullSafe(F.col("component_id")))
    keep = found.select(key("id").alias("key")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), key(id_col).alias("key"))
    first = held.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("record")[text]))).where("n = 1")
    return first.join(keep, "key", "left_semi").select(*[F.col("record")[c].alias(c) for c in docs.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_components(rows: list[tuple[int, str | None]], limit: int = 2) -> pd.DataFrame:
    """All pairs of a small table, for tests."""
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    label = np.arange(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= limit):
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    ids = np.array([r[0] for r in rows])
    return pd.DataFrame({"doc_id": ids, "fingerprint": [f"{x:016x}" for x in fps.tolist()], "component_id": [ids[label == x].min() for x in label]})
