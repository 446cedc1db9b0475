"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

The words that occur most often have vectors of their own; all others share the vectors of classes, by their last three
bytes. The model adds up the vectors of the last CONTEXT symbols, each through a matrix of its place, and compares the sum
with output vectors in two steps, each a batched matrix product that normalises: first with those of the TOP most frequent
words, the classes and the end of a text, then, inside a class, with those of its own words and one for all its other
words, of which each has its add-one share. Probabilities of all words thus add up to 1.

Texts are dealt into groups of bounded size by a hash, and a fixed number of groups makes a replica. A replica trains on
all its training texts from the same start, in the order of their ids; the replicas' parameters are averaged, every row of
a matrix weighted by how often it was a target or a context there. How the input is cut changes nothing.

Counts cover the whole corpus. A group sends each bucket of words its distinct ones with their counts, as compressed
arrays, and gets their sums over all groups back in the same order. No dictionary is ever held whole, and what is sent
grows as the groups' distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACES, crc32_of, one_thread, read, release, stored, trim, word_table
from .suffix_dedup import pack, packed_texts, texts_of, unpack

#: Words with vectors of their own: the size of the model. The most frequent of them are told apart in the first step.
WORDS, TOP = 16_384, 64
#: Classes of words, length of a vector, symbols that the next is predicted from.
CLASSES, DIMENSIONS, CONTEXT = 127, 24, 3
#: Noise symbols drawn for each step of so many tokens.
NOISE, STEP = 48, 4096
#: Bytes of text for each bucket of words and for each group of texts, and whose tokens are handled together.
BUCKET_BYTES, GROUP_BYTES, BATCH_BYTES = 32 << 20, 8 << 20, 2 << 20
#: Groups that a replica is trained on, and parameters that are added up at a time.
REPLICA_GROUPS, ADDED_AT_ONCE = 4, 16
#: Contexts whose predictions are computed together.
CONTEXTS_AT_ONCE = 512
SEED = 11


def held_out(id_col: str = "doc_id") -> Column:
    return crc32_of(F.col(id_col)) % 7 == 2


def word_class(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of each word, by its last three bytes in lower case."""
    code = np.zeros(len(start), np.uint64)
    for k in range(1, 4):
        code = (code << np.uint64(8)) | np.where(end - start >= k, LOWER[data[np.maximum(end - k, 0)]], 0).astype(np.uint64)
    return ((code * np.uint64(2654435761) >> np.uint64(13)) % np.uint64(CLASSES)).astype(np.int64)


def text_blocks(texts: list[tuple[int | None, bytes]]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets): texts, some at a time."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j][1]) <= BATCH_BYTES):
            size += len(texts[j][1])
            j += 1
        own = [t for _, t in texts[i:j]]
        yield [k for k, _ in texts[i:j]], np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in own]))).astype(np.int64)
        i = j


def in_order(texts: pa.Table) -> list[tuple[int | None, bytes]]:
    """(id, text) of packed texts, by id, then by text: the same however they came."""
    return sorted(((i, t) for i, _, t in texts_of(texts)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def group_words(texts: list[tuple[int | None, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, sorted, counts and classes of the distinct words of a group's texts."""
    words, counts, kinds = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    for _, data, at in text_blocks(texts):
        start, end, hashes = word_table(data, at, ~SPACES)
        own, first, n = np.unique(hashes, return_index=True, return_counts=True)
        kind = word_class(data, start[first], end[first]).astype(np.uint8)
        words, first, of = np.unique(np.concatenate((words, own)), return_index=True, return_inverse=True)
        counts = np.bincount(of, np.concatenate((counts, n)), minlength=len(words)).astype(np.int64)
        kinds = np.concatenate((kinds, kind))[first]
    return words, counts, kinds


def _bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


#: A group: its texts as one packed string, or the packed counts of its words in a bucket.
GROUPED = "part int, bucket int, data binary"


def _counted(buckets: int):
    """A group's texts to one packed row (bucket -1), and its words with their training counts, by bucket. Groups with an odd number are held out."""

    def work(texts: pa.Table) -> pa.Table:
        group, whole = texts["part"][0].as_py(), in_order(texts)
        words, counts, kinds = group_words(whole)
        learnt = counts * (group % 2 == 0)
        bucket = _bucket_of(words, buckets)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = [(-1, packed_group(whole))]
        for b in range(buckets):
            own = order[edge[b] : edge[b + 1]]
            if len(own) or b == 0:
                head = np.array([group, b, len(whole) * (group % 2 == 0) if b == 0 else 0], np.int64)
                out.append((b, pack(head=head, hash=words[own], learnt=learnt[own].astype(np.uint32), kind=kinds[own])))
        trim()
        return pa.table({"part": pa.array([group] * len(out), pa.int32()), "bucket": pa.array([b for b, _ in out], pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    return work


def packed_group(texts: list[tuple[int | None, bytes]]) -> bytes:
    """As packed_texts() makes them, for texts_of()."""
    columns = [[i or 0 for i, _ in texts], [int(i is not None) for i, _ in texts], [0] * len(texts), [len(t) for _, t in texts]]
    body = b"".join([*(np.array(c, np.int64).tobytes() for c in columns), *(t for _, t in texts)])
    return b"%d\n" % len(texts) + zstandard.ZstdCompressor(level=3).compress(body)


SUMS = "what int, part int, bucket int, data binary, key bigint, x bigint, n bigint, m bigint"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed words of buckets, summed over all groups. what 0: the counts of a group's words in a bucket, in their order;
    1: a frequent word's hash, class and count; 2: a class, its words and their tokens; 3: texts that were learnt from."""
    heads = [unpack(b) for batch in batches for b in batch.column(2).to_pylist()]
    if not heads:
        return
    words, of = np.unique(np.concatenate([x["hash"] for x in heads]), return_inverse=True)
    count = np.bincount(of, np.concatenate([x["learnt"] for x in heads]), minlength=len(words)).astype(np.int64)
    kind = np.zeros(len(words), np.int64)
    kind[of] = np.concatenate([x["kind"] for x in heads])

    def rows(what: int, size: int, **columns: np.ndarray | list) -> pa.RecordBatch:
        kinds = {"what": pa.int32(), "part": pa.int32(), "bucket": pa.int32(), "data": pa.binary(), "key": pa.int64(), "x": pa.int64(), "n": pa.int64(), "m": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([what] * size if k == "what" else columns.get(k, [None] * size), t) for k, t in kinds.items()], list(kinds))

    at = 0
    for x in heads:
        n = len(x["hash"])
        group, bucket, _ = x["head"].tolist()
        yield rows(0, 1, part=[group], bucket=[bucket], data=[pack(count=count[of[at : at + n]].astype(np.uint32 if not len(count) or count.max() < 1 << 32 else np.uint64))])
        at += n
    top = np.flatnonzero(count > 0)
    top = top[np.lexsort((words[top], -count[top]))[:WORDS]]
    yield rows(1, len(top), key=words[top].view(np.int64), x=kind[top], n=count[top])
    seen = count > 0
    yield rows(2, CLASSES, key=np.arange(CLASSES), n=np.bincount(kind[seen], minlength=CLASSES).astype(np.int64), m=np.bincount(kind[seen], count[seen], minlength=CLASSES).astype(np.int64))
    yield rows(3, 1, m=[sum(int(x["head"][2]) for x in heads)])


@dataclass
class Symbols:
    """What the model tells apart.

    Symbols are, in order: the top words; for each class its own words and one for its others (members); the end; and what
    stands before a text. Outputs of the first step are the top words, the classes and the end.
    """

    hashes: np.ndarray  # of words with vectors of their own, sorted
    symbol: np.ndarray  # of each of these
    top: int
    first: np.ndarray  # first member of each class, and their number: classes + 1
    counts: np.ndarray  # training tokens of each symbol but the last
    class_total: np.ndarray  # tokens + words + 1 of each class's others
    tokens: int  # N
    distinct: int  # V

    @property
    def members(self) -> int:
        return int(self.first[-1])

    @property
    def end(self) -> int:
        return self.top + self.members

    @property
    def ends(self) -> int:
        return int(self.counts[-1])

    @classmethod
    def of(cls, sums: DataFrame) -> Symbols:
        """From the rows of _sums: WORDS words, and one row for each class."""
        found = sums.where("what = 1").orderBy(F.col("n").desc(), "key").limit(WORDS).select("key", "x", "n").collect()
        classes = np.zeros((CLASSES, 2), np.int64)
        for r in sums.where("what = 2").groupBy("key").agg(F.sum("n").alias("words"), F.sum("m").alias("tokens")).collect():
            classes[r.key] = r.words, r.tokens
        ends = int(sums.where("what = 3").agg(F.sum("m")).first()[0] or 0)
        return cls.made(np.array([tuple(r) for r in found], np.int64).reshape(-1, 3), classes, ends)

    @classmethod
    def made(cls, words: np.ndarray, classes: np.ndarray, ends: int) -> Symbols:
        """words: (hash, class, count) of the most frequent ones in order; classes: (words, tokens) of all words of each."""
        top = min(TOP, len(words))
        distinct, tokens = int(classes[:, 0].sum()) + (ends > 0), int(classes[:, 1].sum()) + ends
        others = classes - np.stack([np.bincount(words[:, 1], minlength=CLASSES), np.bincount(words[:, 1], words[:, 2], minlength=CLASSES)], axis=1).astype(np.int64)
        kind = words[top:, 1]
        size = np.bincount(kind, minlength=CLASSES) + 1  # the last member is a class's other words
        first = np.concatenate(([0], np.cumsum(size)))
        order = np.argsort(kind, kind="stable")
        member = np.empty(len(kind), np.int64)
        member[order] = np.arange(len(kind)) + kind[order]  # behind the last members of the classes before
        symbol = np.concatenate((np.arange(top), top + member))
        counts = np.zeros(top + int(first[-1]) + 1, np.int64)
        counts[symbol] = words[:, 2]
        counts[top + first[1:] - 1] = others[:, 1]
        counts[-1] = ends
        hashes = words[:, 0].copy().view(np.uint64)
        by_hash = np.argsort(hashes)
        return cls(hashes[by_hash], symbol[by_hash], top, first, counts, others.sum(axis=1) + 1, tokens, distinct)

    def own(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word that has one of its own, else -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.symbol[place], -1)

    def sequences(self, data: np.ndarray, at: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, text, contexts) of every token, the ends included; a context before the text's start is ``end + 1``. ``words`` and ``own`` are given if known."""
        start, end, hashes = words or word_table(data, at, ~SPACES)
        symbol = self.own(hashes) if own is None else own.copy()
        other = np.flatnonzero(symbol < 0)
        symbol[other] = self.top + self.first[1:][word_class(data, start[other], end[other])] - 1
        n = len(at) - 1
        of = texts_with(start, at)
        place = np.arange(len(start)) + of  # an end stands behind the words of each text
        total = np.full(len(start) + n, self.end, np.int32)
        total[place] = symbol
        size = np.bincount(of, minlength=n) + 1
        text = np.repeat(np.arange(n, dtype=np.int32), size)
        first = np.repeat(np.cumsum(size) - size, size)
        spot = np.arange(len(total))
        context = np.full((len(total), CONTEXT), self.end + 1, np.int32)
        for j in range(1, CONTEXT + 1):
            inside = spot - j >= first
            context[inside, j - 1] = total[spot[inside] - j]
        return total, text, context


def texts_with(start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """owners() of spans in their order."""
    return np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))


def in_turn(index: np.ndarray) -> np.ndarray:
    """Stable order of small numbers from -1 up; NumPy sorts 16 bits by radix."""
    return np.argsort((index + 1).astype(np.uint16) if len(index) and index.max() < 65_535 else index, kind="stable")


def summed_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices, and the sum of the rows of each."""
    order = in_turn(index)
    ordered = index.take(order)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rows = rows.take(order, axis=0)
    if rows.dtype == np.float32 and rows.shape[1] % 2 == 0:  # by pairs: reduceat() takes its time by column and index
        return ordered.take(first), np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)
    return ordered.take(first), np.add.reduceat(rows, first, axis=0)


class Softmax:
    """Output vectors and biases of one step, and their gradients by noise-contrastive estimation."""

    def __init__(self, counts: np.ndarray):
        self.noise = (counts + 1.0) / (counts + 1.0).sum()
        self.cumulative = np.cumsum(self.noise)
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)

    def gradients(self, q: np.ndarray, y: np.ndarray, out: np.ndarray, bias: np.ndarray, rng: np.random.Generator, of_q: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Of the predictions (if ``of_q``), the vectors and the biases, for targets y, with NOISE symbols drawn for all of them."""
        drawn = np.minimum(np.searchsorted(self.cumulative, rng.random(NOISE)), len(out) - 1)
        own, noise = out.take(y, axis=0), out.take(drawn, axis=0)
        g_real = np.einsum("bd,bd->b", q, own) + (bias - self.log_noise).take(y)
        fake = q @ -noise.T
        fake -= bias[drawn] - self.log_noise[drawn]
        with np.errstate(over="ignore"):
            for x in (g_real, fake):  # of log sigmoid(real), and of -log sigmoid(-fake)
                np.exp(x, out=x)
                x += 1
                np.divide(1, x, out=x)
        g_q = None
        if of_q:
            g_q = fake @ -noise
            own *= g_real[:, None]
            g_q += own
        g_out, g_bias = np.zeros_like(out), np.bincount(y, g_real, minlength=len(bias)).astype(np.float32)
        seen, rows = summed_rows(y, g_real[:, None] * q)
        g_out[seen] = rows
        np.subtract.at(g_out, drawn, (q.T @ fake).T)
        np.subtract.at(g_bias, drawn, np.ones(len(y), np.float32) @ fake)
        return g_q, g_out, g_bias


class LogBilinear:
    """Parameters of the model, their training by noise-contrastive estimation, and normalised predictions."""

    def __init__(self, symbols: Symbols, dimensions: int = DIMENSIONS, seed: int = SEED):
        rng, top, first = np.random.default_rng(seed), symbols.top, symbols.first
        self.top, self.first, self.end = top, first, symbols.end
        self.placed: list[np.ndarray] | None = None  # context vectors through the matrix of each place, for predictions
        of_class = np.add.reduceat(symbols.counts[top:-1], first[:-1])
        self.outputs = top + CLASSES + 1
        #: Output of the first step of each symbol, and its class or -1.
        self.kind = np.concatenate((np.full(top, -1), np.repeat(np.arange(CLASSES), np.diff(first)), [-1]))
        self.output = np.concatenate((np.arange(top), top + self.kind[top:-1], [self.outputs - 1]))
        self.head = Softmax(np.concatenate((symbols.counts[:top], of_class, symbols.counts[-1:])))
        self.tails = [Softmax(symbols.counts[top + a : top + b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.values = [
            small(symbols.end + 2, dimensions),  # of contexts
            np.stack([np.eye(dimensions, dtype=np.float32) / CONTEXT] * CONTEXT),  # of places
            small(self.outputs, dimensions),
            np.log(self.head.noise).astype(np.float32),
            small(symbols.members, dimensions),
            np.concatenate([np.log(t.noise) for t in self.tails]).astype(np.float32),
        ]

    def predicted(self, context: np.ndarray) -> np.ndarray:
        """A prediction for each row of contexts, and 1 behind it: the factor of a bias."""
        if self.placed is None:
            self.placed = [self.values[0] @ place for place in self.values[1]]
        q = np.ones((len(context), self.placed[0].shape[1] + 1), np.float32)
        for i in range(0, len(context), STEP):
            c = context[i : i + STEP]
            q[i : i + STEP, :-1] = sum(self.placed[j].take(c[:, j], axis=0) for j in range(CONTEXT))
        return q

    def train(self, target: np.ndarray, context: np.ndarray, rng: np.random.Generator, state: dict) -> None:
        """One pass over tokens: the first step STEP at a time, then the members of each class. Vectors and matrices of the
        contexts learn from the first step. Adam steps, but for the rows of contexts and members, which take Adagrad's."""
        seen, places, self.placed = self.values[0], self.values[1], None
        if not state:
            state |= {"t": 0, "seen": np.full(len(seen), 1e-8, np.float32), "tail": np.full(len(self.values[4]), 1e-8, np.float32), "m": [0.0] * 3, "v": [0.0] * 3}
        output, said = self.output[target], np.empty((len(target), places.shape[2]), np.float32)
        for i in range(0, len(target), STEP):
            y, c = output[i : i + STEP], context[i : i + STEP]
            inner = seen.take(c, axis=0).reshape(len(c), -1)  # the vectors of all places, side by side
            q = said[i : i + STEP] = inner @ places.reshape(-1, places.shape[2])
            g_q, g_out, g_bias = self.head.gradients(q, y, self.values[2], self.values[3], rng)
            g_places = (inner.T @ g_q).reshape(places.shape)
            own, rows = summed_rows(c.ravel(), (g_q @ places.reshape(-1, places.shape[2]).T).reshape(-1, seen.shape[1]))
            state["t"] += 1
            t = state["t"]
            rate = 0.02 / np.sqrt(1 + t / 50)
            for k, at, g in ((0, 1, g_places), (1, 2, g_out), (2, 3, g_bias)):
                g = g / len(y)
                m = state["m"][k] = 0.9 * state["m"][k] + 0.1 * g
                v = state["v"][k] = 0.99 * state["v"][k] + 0.01 * g * g
                self.values[at] += (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
            _adagrad(seen, state["seen"], own, rows, SEEN_RATE)
        kind = self.kind[target]
        order = in_turn(kind)
        edge = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            a, b = int(self.first[k]), int(self.first[k + 1])
            if b - a < 2:
                continue
            for i in range(edge[k], edge[k + 1], STEP):
                own = order[i : min(i + STEP, edge[k + 1])]
                out, bias = self.values[4][a:b], self.values[5][a:b]
                _, g_out, g_bias = self.tails[k].gradients(said.take(own, axis=0), target.take(own) - (self.top + a), out, bias, rng, of_q=False)
                _adagrad(out, state["tail"][a:b], slice(None), g_out, TAIL_RATE)
                bias += 0.5 * g_bias / len(own)

    def log10_probabilities(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Normalised over all symbols of the first step, and over the members of a class."""
        q = self.predicted(context)
        found = _log_softmax(q, np.column_stack((self.values[2], self.values[3])), self.output[target])
        kind = self.kind[target]
        order = in_turn(kind)
        edge = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            a, b = int(self.first[k]), int(self.first[k + 1])
            if b - a > 1:
                own = order[edge[k] : edge[k + 1]]
                found[own] += _log_softmax(q.take(own, axis=0), np.column_stack((self.values[4][a:b], self.values[5][a:b])), target.take(own) - (self.top + a))
        return found / np.log(10)


#: Rates of the context vectors and of the members' vectors.
SEEN_RATE, TAIL_RATE = 0.03, 0.03


def _adagrad(values: np.ndarray, total: np.ndarray, own: np.ndarray | slice, g: np.ndarray, rate: float) -> None:
    """A step for some rows, each with one sum of squares."""
    total[own] += np.einsum("bd,bd->b", g, g) / g.shape[1]
    values[own] += g * (rate / np.sqrt(total[own]))[:, None]


def _log_softmax(q: np.ndarray, out: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the normalised probability of each row's target. The last columns are 1 and the biases."""
    found, ones = np.empty(len(q)), np.ones(len(out), np.float32)
    if not len(q):
        return found
    length = [np.einsum("bd,bd->b", x[:, :-1], x[:, :-1]).max() for x in (q, out)]
    most = np.sqrt(length[0] * length[1]) + np.abs(out[:, -1]).max()
    kept = np.empty((min(len(q), CONTEXTS_AT_ONCE), len(out)), np.float32)
    for i in range(0, len(q), CONTEXTS_AT_ONCE):
        some = q[i : i + CONTEXTS_AT_ONCE]
        score = np.matmul(some, out.T, out=kept[: len(some)])
        if not most < 70:  # else float32 holds all powers and their sums
            score -= score.max(axis=1, keepdims=True)
        own = score[np.arange(len(some)), target[i : i + CONTEXTS_AT_ONCE]]
        np.exp(score, out=score)
        found[i : i + CONTEXTS_AT_ONCE] = own - np.log(score @ ones)
    return found


def _trained(symbols: Symbols):
    """A replica's groups (replica, part, data) to its number, and its parameters with their weights."""

    def work(groups: pa.Table) -> pa.Table:
        one_thread()
        own, rng, state = LogBilinear(symbols), np.random.default_rng(SEED), {}
        as_context, as_target = np.zeros(symbols.end + 2), np.zeros(symbols.end + 1)
        for k in np.argsort(groups["part"].to_numpy()).tolist():
            for _, data, at in text_blocks([(i, t) for i, _, t in texts_of(groups.slice(k, 1))]):
                target, _, context = symbols.sequences(data, at)
                mixed = rng.permutation(len(target))
                own.train(target.take(mixed), context.take(mixed, axis=0), rng, state)
                as_context += np.bincount(context.ravel(), minlength=len(as_context))
                as_target += np.bincount(target, minlength=len(as_target))
        of_output = np.bincount(own.output, as_target, minlength=own.outputs)
        members = as_target[symbols.top : -1]
        weights = [w + 1e-3 for w in (as_context, np.full(CONTEXT, as_target.sum()), of_output, of_output, members, members)]
        trim()
        return _replica(groups["replica"][0].as_py(), [v * w.reshape(-1, *[1] * (v.ndim - 1)) for v, w in zip(own.values, weights, strict=True)], weights)

    return work


def _replica(number: int, values: list[np.ndarray], weights: list[np.ndarray]) -> pa.Table:
    flat = np.concatenate([x.ravel() for x in (*values, *weights)]).astype(np.float64)
    return pa.table({"replica": pa.array([number], pa.int32()), "data": pa.array([flat.tobytes()], pa.binary())})


def _added(replicas: pa.Table) -> pa.Table:
    """Parameters of some replicas, added in the order of their numbers."""
    total = None
    for k in np.argsort(replicas["replica"].to_numpy()).tolist():
        x = np.frombuffer(replicas["data"][k].as_py(), np.float64)
        total = x.copy() if total is None else total + x
    return pa.table({"replica": pa.array([replicas["into"][0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def fit(groups: DataFrame, symbols: Symbols, n_groups: int) -> LogBilinear:
    """Trains on groups of texts (part, data), with the average of all replicas' parameters. Parts with an odd number are left out."""
    model = LogBilinear(symbols)
    parts = groups.where("part % 2 = 0").withColumn("replica", F.expr(f"cast(floor(part / {2 * REPLICA_GROUPS}) as int)"))
    own = parts.groupBy("replica").applyInArrow(_trained(symbols), "replica int, data binary")
    n = -(-n_groups // REPLICA_GROUPS)
    while True:
        own = own.withColumn("into", F.expr(f"cast(floor(replica / {ADDED_AT_ONCE}) as int)")).groupBy("into").applyInArrow(_added, "replica int, data binary")
        n = -(-n // ADDED_AT_ONCE)
        if n <= 1:
            break
    summed = own.collect()
    if summed:
        flat, at = np.frombuffer(summed[0].data, np.float64), 0
        sizes = [v.size for v in model.values] + [len(v) for v in model.values]
        parts_ = np.split(flat, np.cumsum(sizes)[:-1])
        half = len(model.values)
        for k, v in enumerate(model.values):
            model.values[k] = (parts_[k].reshape(v.shape) / parts_[half + k].reshape(-1, *[1] * (v.ndim - 1))).astype(np.float32)
    return model


SCORED = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(symbols: Symbols, model: LogBilinear, buckets: int):
    """A group's texts, and the counts of its words, to their scores."""

    def work(texts: pa.Table, sums: pa.Table) -> pa.Table:
        one_thread()
        # What a symbol adds besides its probability: nothing of its own word; a class's share of its other words.
        others = symbols.top + symbols.first[1:] - 1
        own = np.log10(symbols.counts + 1.0)
        own[others] = np.log10(symbols.class_total)
        whole = [(i, t) for i, _, t in texts_of(texts)]
        tables = [word_table(data, at, ~SPACES) for _, data, at in text_blocks(whole)]
        words, places = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t[2] for t in tables)]), return_inverse=True)
        placed = np.split(places, np.cumsum([len(t[2]) for t in tables])[:-1])
        count = np.zeros(len(words), np.int64)
        bucket = _bucket_of(words, buckets)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, data in zip(sums["bucket"].to_pylist(), sums["data"].to_pylist(), strict=True):
            count[order[edge[b] : edge[b + 1]]] = unpack(data)["count"]
        log_count, own_symbol = np.log10(count + 1.0), symbols.own(words)
        base = np.log10(symbols.tokens + symbols.distinct + 1)
        held = texts.num_rows > 0 and texts["part"][0].as_py() % 2 == 1
        out: list[tuple[np.ndarray | list, ...]] = []
        for (ids, data, at), table, place in zip(text_blocks(whole), tables, placed, strict=True):
            n, of = len(ids), texts_with(table[0], at)
            sums_ = np.bincount(of, log_count[place], minlength=n) + np.log10(symbols.ends + 1.0)
            known = np.bincount(of, count[place] > 0, minlength=n).astype(np.int64) + (symbols.ends > 0)
            target, text, context = symbols.sequences(data, at, table, own_symbol[place])
            tokens = np.bincount(text, minlength=n)
            model_part = np.bincount(text, model.log10_probabilities(target, context) - own[target], minlength=n)
            out.append((ids, tokens, known, sums_ - tokens * base, sums_ + model_part))
        columns = [sum((list(x[k]) for x in out), []) for k in range(5)]
        trim()
        n = len(columns[0])
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        values = [columns[0], [held] * n, columns[1], columns[2], [symbols.tokens] * n, columns[3], columns[4]]
        return pa.table({k.split()[0]: pa.array(v, t) for k, v, t in zip(SCORED.split(", "), values, kinds, strict=True)})

    return work


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``; ids are whole numbers.

    The rows that ``held`` does not mark are learnt from. Null and empty texts are one token, the end. Without any
    row to learn from, nothing is known and the base scores are 0. Repeated rows count as often as they stand, and each
    has its result. An empty table gives no rows. A text must fit in a Python worker's memory some thirty times over,
    whatever its length. Other columns than these two, and those of ``held``, are not read. How the rows are cut into
    partitions changes no score; their total bytes decide the number of groups, and so which texts train together.
    """
    if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("ids must be whole numbers")
    total = docs.select(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets, groups = max(8, -(-total // BUCKET_BYTES)), max(1, -(-total // GROUP_BYTES))
    ident, body = F.col(id_col).cast("long"), F.col(text).cast("string")
    group = 2 * F.pmod(F.xxhash64(ident, body), F.lit(groups)) + F.coalesce(held, F.lit(False)).cast("int")
    rows = docs.select(ident.alias("id"), F.lit(0).cast("long").alias("row"), group.cast("int").alias("part"), F.coalesce(body, F.lit("")).alias("text"))
    counted = stored(rows.mapInArrow(packed_texts, "part int, data binary").groupBy("part").applyInArrow(_counted(buckets), GROUPED))
    release(docs.sparkSession)
    texts = counted.where("bucket = -1").select("part", "data")
    sums = stored(counted.where("bucket >= 0").repartitionById(buckets, F.col("bucket")).mapInArrow(_sums, SUMS))
    symbols = Symbols.of(sums)
    model = fit(texts, symbols, groups)
    counts = sums.where("what = 0").select("part", "bucket", "data")
    return texts.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_scored(symbols, model, buckets), SCORED)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt from those that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, held_out()).withColumnRenamed("id", "doc_id")
