"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a seed. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds) those of its n-grams. A
language's prototype bundles the unit vectors of its training texts. A text has the language whose prototype has the
largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of, one_thread, read, trim

UNKNOWN = "und"
DIMENSIONS = 512
GRAM = 3
SEED = 7
#: Unit vectors are added up in whole multiples of 1/SCALE, so that the sums do not depend on the order.
SCALE = 1 << 20
#: Languages that the driver holds prototypes of at most.
MOST_LANGUAGES = 5_000
#: Cells of a count matrix, and n-grams that are multiplied at a time.
CELLS, GRAMS_AT_ONCE = 1 << 20, 4096
#: Code points, and rows, that are taken at a time.
CHARS_AT_ONCE, ROWS_AT_ONCE = 1 << 19, 512

_letters: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0 stands for the space between words."""
    out = np.empty((len(points), dimensions), np.int8)
    for i, p in enumerate(points.tolist()):
        out[i] = _letter_vector(p, dimensions, seed)
    return out


@lru_cache(1 << 14)
def _letter_vector(point: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, point]).integers(0, 2, dimensions, np.int8) * 2 - 1


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vectors of the texts, and how many letters each has. Whole texts, a bounded number of letters at a time."""
    total = np.zeros((len(texts), dimensions), np.float64)
    letters = np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = is_letter(points)
        letters[i] = int(known.sum())
        if not letters[i]:
            continue
        points = np.where(known, points, 0)
        keep = np.ones(len(points), bool)
        keep[1:] = known[1:] | known[:-1]  # one space for each run of other characters
        points = np.concatenate(([0], points[keep], [0])).astype(np.int64)
        if points[1] == 0:
            points = points[1:]
        if len(points) > 1 and points[-2] == 0:
            points = points[:-1]
        for a in range(0, len(points), CHARS_AT_ONCE):
            part = points[a : a + CHARS_AT_ONCE + gram - 1]
            if len(part) < gram:
                continue
            held.append((i, part))
            size += len(part)
            if size >= CHARS_AT_ONCE:
                _bundle(total, held, dimensions, gram, seed)
                held, size = [], 0
    if held:
        _bundle(total, held, dimensions, gram, seed)
    return total, letters


def _bundle(total: np.ndarray, held: list[tuple[int, np.ndarray]], dimensions: int, gram: int, seed: int) -> None:
    """Add the n-gram vectors of parts of texts to the texts' vectors."""
    flat = np.concatenate([x for _, x in held])
    alphabet, symbol = np.unique(flat, return_inverse=True)
    vectors = letter_vectors(alphabet, dimensions, seed)
    code = np.zeros(len(flat) - gram + 1, np.int64)
    for k in range(gram):
        code = code * len(alphabet) + symbol[k : len(flat) - gram + 1 + k]
    part = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
    inside = part[: len(code)] == part[gram - 1 :]
    code, part = code[inside], part[: len(inside)][inside]
    if len(alphabet) ** gram <= 1 << 22:
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(len(alphabet) ** gram, np.int64)
        place[seen] = np.arange(len(seen))
        which = place[code]
    else:
        seen, which = np.unique(code, return_inverse=True)
    rows = np.array([i for i, _ in held])
    for g in range(0, len(seen), GRAMS_AT_ONCE):
        grams = seen[g : g + GRAMS_AT_ONCE]
        bound = np.ones((len(grams), dimensions), np.int8)
        rest = grams.copy()
        for k in range(gram):  # the last letter first, unpermuted
            bound *= np.roll(vectors, k, axis=1)[rest % len(alphabet)]
            rest //= len(alphabet)
        bound = bound.astype(np.float32)
        if len(seen) > GRAMS_AT_ONCE:
            own = (which >= g) & (which < g + len(grams))
            of, col = part[own], which[own] - g
        else:
            of, col = part, which
        step = max(1, CELLS // len(grams))
        edges = np.searchsorted(of, np.arange(0, len(held) + step, step))
        for k in range(len(edges) - 1):
            a, b = edges[k], edges[k + 1]
            n = min(step, len(held) - k * step)
            counts = np.bincount((of[a:b] - k * step) * len(grams) + col[a:b], minlength=n * len(grams)).reshape(n, -1).astype(np.float32)
            np.add.at(total, rows[k * step : k * step + n], counts @ bound)


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes: the sums of the unit vectors of all their texts.

    Rows without a language, text or letter teach nothing. The driver gets one vector for each language.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                vectors = np.rint(unit(text_vectors(part.column(0).to_pylist(), dimensions, gram, seed)[0]) * SCALE).astype(np.int64)
                names = np.array(part.column(1).to_pylist(), object)
                for name in set(names.tolist()):
                    sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0)
                trim()
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v)], ["lang", "k", "v"])

    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(work, "lang string, k int, v bigint").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("v"))
    found = vectors.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = sorted((r for r in found if any(r.v)), key=lambda r: r.lang)
    return [r.lang for r in found], unit(np.array([r.v for r in found], np.float64).reshape(len(found), dimensions))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text: str = "text", gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """(id, lang_pred, score) for each row: the language with the largest cosine (of equals the first by name), and that cosine, 0 at least.

    Null, empty and letterless texts are ``und`` with score 0, and so is every text if there is no prototype. Repeated
    rows give repeated rows, an empty table none. A text is read as a whole, whatever its length: a Python worker must
    hold it some twenty times over. Other columns than these two are not read.
    """
    names, prototypes = model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                vectors, letters = text_vectors(part.column(1).to_pylist(), prototypes.shape[1], gram, seed)
                if not names:
                    letters[:] = 0
                near = unit(vectors) @ prototypes.T if names else np.zeros((part.num_rows, 1))
                best = near.argmax(axis=1)
                lang = [names[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters > 0, np.clip(near[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])
                trim()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(work, f"id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return crc32_of(F.col(id_col)) % 3 == 1


def trained_on(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the documents that are not held out."""
    return train(docs.where(~held_out()))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, trained_on(docs))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
