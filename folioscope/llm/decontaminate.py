"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of documents. Its words become symbols of the benchmark's vocabulary; a run of symbols too
short for any window cannot hold an occurrence and is left out. The symbol text gets a suffix array (prefix doubling),
its Burrows-Wheeler transform as a wavelet tree, and sampled suffix positions. Every benchmark window is searched
backwards through the tree's ranks, its occurrences are located by walking to the nearest sample, and the words they
cover are merged into spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, blocks, owners, read, runs, text_hashes, word_table

#: Bytes of benchmark text that a pass over the documents searches for; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20
#: One suffix position in so many is kept.
SAMPLE = 8
#: Rows located at a time.
LOCATE_AT_ONCE = 1 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols by prefix doubling; the last symbol must be the smallest and stand nowhere else."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] if step < n else 0
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rank = new
        if rank.max(initial=0) == n or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Ranks over a sequence of small integers: a bit row for each level, zeros before ones."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros, self.values = [], [], values
        row = values
        for k in range(self.levels - 1, -1, -1):
            bit = (row >> k) & 1
            count = np.zeros(len(row) + 1, np.int64)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(row) - int(count[-1]))
            row = np.concatenate((row[bit == 0], row[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - level)) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Count and locate patterns in a text of symbols below ``symbols``."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        self.n = len(text)
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.kept = order % sample == 0
        self.kept[order == 0] = True
        self.kept_at = np.cumsum(self.kept) - 1
        self.positions = order[self.kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern, backwards from its last symbol."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - k]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back through the text until a sampled position."""
        out, steps, row = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.kept[row[open_]]
            hit = open_[done]
            out[hit] = self.positions[self.kept_at[row[hit]]] + steps[hit]
            open_ = open_[~done]
            symbol = self.tree.values[row[open_]]
            row[open_] = self.first[symbol] + self.tree.rank(symbol, row[open_])
            steps[open_] += 1
        return out


@dataclass
class Phrases:
    """The windows of some benchmark items, as symbols of their own vocabulary, 2 and up; 1 separates runs and 0 ends a text."""

    vocabulary: np.ndarray  # sorted word hashes
    patterns: np.ndarray  # a row for each distinct window, 0 after its end
    lengths: np.ndarray
    windows: np.ndarray  # (window, item) pairs, by window
    items: np.ndarray
    ids: list[str | None]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], size: int) -> Phrases:
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        start, _, hashes = word_table(np.frombuffer(b"".join(texts), np.uint8), at, WORD_BYTES)
        vocabulary, symbol = np.unique(hashes, return_inverse=True)
        of_item = owners(start, at)
        found: dict[tuple[int, ...], set[int]] = {}
        for item in range(len(rows)):
            own = (symbol[of_item == item] + 2).tolist()
            for i in range(max(1, len(own) - size + 1) if own else 0):
                found.setdefault(tuple(own[i : i + size]), set()).add(item)
        patterns = np.zeros((len(found), size), np.int64)
        for k, p in enumerate(found):
            patterns[k, : len(p)] = p
        pairs = np.array([(k, x) for k, s in enumerate(found.values()) for x in sorted(s)], np.int64).reshape(-1, 2)
        return cls(vocabulary, patterns, (patterns > 0).sum(axis=1), pairs[:, 0], pairs[:, 1], [i for i, _ in rows])


def occurrences(phrases: Phrases, hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, window) of every occurrence of a window among the words of a shard's texts."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(phrases.lengths):
        return none, none
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[place] == hashes, place + 2, 0)
    # Maximal runs of known words inside a text; too short a run holds no window.
    known = symbol > 0
    breaks = np.concatenate(([True], ~known[1:] | ~known[:-1] | (text_of[1:] != text_of[:-1])))
    first = np.flatnonzero(breaks)
    size = np.diff(np.append(first, len(symbol)))
    keep = known[first] & (size >= phrases.lengths.min())
    first, size = first[keep], size[keep]
    if not len(first):
        return none, none
    ends = np.cumsum(size + 1)
    text = np.ones(int(ends[-1]), np.int64)
    text[-1] = 0
    word = np.full(len(text), -1, np.int64)
    spot = np.arange(len(text)) - np.repeat(ends - size - 1, size + 1)
    inner = spot < np.repeat(size, size + 1)
    word[inner] = (np.repeat(first, size + 1) + spot)[inner]
    text[inner] = symbol[word[inner]]
    index = FMIndex(text, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.patterns, phrases.lengths)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    at = [index.locate(rows[i : i + LOCATE_AT_ONCE]) for i in range(0, len(rows), LOCATE_AT_ONCE)]
    return word[np.concatenate([none, *at])], window


FOUND = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def _search_shard(phrases: Phrases, data: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """The FOUND columns of a shard's texts."""
    start, end, hashes = word_table(data, at, WORD_BYTES)
    n, text_of = len(at) - 1, owners(start, at)
    word, window = occurrences(phrases, hashes, text_of)
    covered = np.zeros(len(start) + 1, np.int64)
    np.add.at(covered, word, 1)
    np.add.at(covered, word + phrases.lengths[window], -1)
    hit = np.cumsum(covered)[:-1] > 0
    # Items of each text.
    pair = np.unique(text_of[word] * max(1, len(phrases.lengths)) + window) if len(word) else np.zeros(0, np.int64)
    many = max(1, len(phrases.lengths))
    low = np.searchsorted(phrases.windows, pair % many)
    count = np.searchsorted(phrases.windows, pair % many, "right") - low
    item = phrases.items[np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
    both = np.unique(np.repeat(pair // many, count) * max(1, len(phrases.ids)) + item)
    names = [phrases.ids[x] for x in (both % max(1, len(phrases.ids))).tolist()]
    lists: list[list[str]] = [[] for _ in range(n)]
    for t, name in zip((both // max(1, len(phrases.ids))).tolist(), names, strict=True):
        if name is not None:
            lists[t].append(name)
    # Runs of hit words inside a text.
    edge = np.flatnonzero(hit)
    if len(edge):
        fresh = np.concatenate(([True], (edge[1:] != edge[:-1] + 1) | (text_of[edge[1:]] != text_of[edge[:-1]])))
        first, last = edge[fresh], edge[np.append(np.flatnonzero(fresh)[1:] - 1, len(edge) - 1)]
    else:
        first = last = edge
    removed = [[] for _ in range(n)]
    for t, a, b in zip(text_of[first].tolist(), (start[first] - at[text_of[first]]).tolist(), (end[last] - at[text_of[last]]).tolist(), strict=True):
        removed[t].append({"start": a, "end": b})
    return [
        pa.array(np.bincount(text_of, minlength=n).astype(np.int64)),
        pa.array(np.bincount(text_of[hit], minlength=n).astype(np.int64)),
        pa.array([sorted(set(x)) for x in lists], pa.list_(pa.string())),
        pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, pass_bytes: int = PASS_BYTES, clean: bool = False) -> DataFrame:
    """(id, text, n_words, n_hit, items, spans) for each row of ``docs``; with ``clean`` also that: the text without the spans.

    Words are maximal runs of letters and digits (any character beyond ASCII is one), A-Z in lower case. A window is
    ``window`` consecutive words of an item, or all words of a shorter one. n_hit: words inside an occurrence.
    items: ids, as strings, sorted, of the items with an occurring window; an item without an id hits words but isn't
    listed. spans: UTF-8 byte ranges of the maximal runs of hit words. Null and empty texts have no words.
    Repeated rows give repeated rows, an empty table none; an empty benchmark hits nothing. Extra columns are not read.
    A text is searched as a whole, whatever its length: a Python worker must hold it some twenty times over.

    The driver holds ``pass_bytes`` of benchmark text at a time; more of it is searched in further passes, whose
    results meet by row.
    """
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = bench.select(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = []
    for k in range(passes):
        own = bench if passes == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        phrases = Phrases.of([(r.i, r.t) for r in own.collect()], window)

        def work(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            for rows, data, at in blocks(batches, "text"):
                hits = _search_shard(phrases, data, at)
                own = [_cleaned(rows.column(1), hits[-1])] if clean and passes == 1 else []
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *hits, *own], ["id", "text", "n_words", "n_hit", "items", "spans", "clean"][: 6 + len(own)])

        found.append(source.mapInArrow(work, f"id {kind}, text string, {FOUND}" + (", clean string" if clean and passes == 1 else "")))
    if passes == 1:
        return found[0]
    merged = _merged(found)
    if not clean:
        return merged

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _cleaned(batch.column(1), batch.column(5))], [*batch.schema.names, "clean"])

    return merged.mapInArrow(cut_out, f"id {kind}, text string, {FOUND}, clean string")


def _merged(found: list[DataFrame]) -> DataFrame:
    """The passes' results of each row as one. Rows that repeat each other have one result, as often as they stand."""
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.withColumn("of_text", F.xxhash64("text"))
    one = every.groupBy("id", "of_text").agg(F.first("text").alias("text"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), (F.count(F.lit(1)) / len(found)).cast("int").alias("times"))
    start = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), start)["end"] >= s["start"]), F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))).otherwise(F.array_append(acc, s))
    merged = F.aggregate("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"), step)
    words = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    held = lambda s: F.size(F.regexp_extract_all(F.decode(F.substring(F.encode("text", "UTF-8"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8"), F.lit(words), F.lit(0)))
    one = one.withColumn("spans", merged).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + held(s)))
    return one.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select("id", "text", "n_words", "n_hit", "items", "spans")


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without the byte ranges; the white space on both sides of a range becomes one space."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    out.append(data[at:])
    return b" ".join(x.strip() if 0 < i < len(out) - 1 else x.rstrip() if i == 0 else x.lstrip() for i, x in enumerate(out)).decode("utf-8", "surrogatepass").strip()


def _cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without its spans; one without any as it is."""
    out: list[pa.Array] = []
    for i in range(0, len(texts), 512):
        pairs = zip(texts.slice(i, 512).to_pylist(), spans.slice(i, 512).to_pylist(), strict=True)
        out.append(pa.array([without_spans(t, s) if s else t for t, s in pairs], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the words of benchmark windows taken out of ``text``; a text without any stays as it is, and so do the other columns.

    Null texts stay null; repeated rows, empty tables and very long texts are as in find_contamination(); other columns may
    have any names.
    """
    rest = [c for c in docs.columns if c != text]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(text))
    found = find_contamination(kept, benchmark, "rest", text, clean=True, **options)
    return found.select(*[F.col("clean").alias(text) if c == text else F.col("id")[c].alias(c) for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark's items."""
    found = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
item_starts AS (
    SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS line FROM item_starts),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size),
hits AS (SELECT s.doc_id, s.i, s.size, x.item_id FROM (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS line FROM starts) s JOIN windows x USING (size, line)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
