"""Shared pieces of the corpus operators: text buffers, word spans, hashes, and intermediate tables.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import ctypes
import gc
import glob
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at a time.
BLOCK_BYTES = 4 << 20

#: Bytes whose words are hashed at a time: a worker keeps some 16 bytes for each of these.
WORD_TABLE_BYTES = 1 << 20

#: ASCII white space: the separators of the word class ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Letters and digits of ASCII, and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True

#: Lower case of A-Z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own, in local mode alone."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: a lost executor costs nothing that was done before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), in Parquet: for wide or text rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/folioscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of(col: Column) -> Column:
    """CRC-32 of the column as text; null as the empty string."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings end to end, and the n + 1 offsets of the strings in them. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Give freed memory back to the system: workers wait between tasks, and what they keep counts."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


@cache
def one_thread() -> None:
    """One thread for NumPy's matrix products in this worker: tasks are the parallelism, and waiting threads take CPU."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): runs of rows whose texts hold about ``most`` bytes together; a longer text comes alone."""
    for batch in batches:
        data, at = flat(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
            trim()


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses a text's boundary."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Other values of the bytes, for hashes independent of the first.
OTHER_BYTE = np.random.default_rng(20_240_503).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, b, b**2, ... modulo 2**64, of the hash's base or of its inverse."""
    kept = _powers.get("i" if inverse else "p")
    if kept is None or len(kept) < n:
        size, base = max(1 << 16, n), _INVERSE if inverse else _BASE
        kept = np.ones(size, np.uint64)
        kept[1:] = base
        with np.errstate(over="ignore"):
            np.multiply.accumulate(kept, out=kept)
        _powers["i" if inverse else "p"] = kept
    return kept[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """n + 1 running sums of byte values times powers; a difference of two is a substring's polynomial, shifted by its start."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[data] * powers(len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end); equal substrings have equal hashes, wherever they stand."""
    with np.errstate(over="ignore"):
        x = (sums[end] - sums[start]) * powers(len(sums), inverse=True)[start]
        return mixed(x + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_hashes(texts: list[bytes]) -> np.ndarray:
    """span_hashes() of whole strings."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=at[1:])
    return span_hashes(prefix_sums(np.frombuffer(b"".join(texts), np.uint8)), at[:-1], at[1:])


def owners(start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the text that each span lies in."""
    return np.searchsorted(at, start, "right") - 1


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs; touching spans become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.concatenate((first[1:], [True]))
    return start[first], reach[last]


def word_table(data: np.ndarray, at: np.ndarray, inside: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of the texts: runs of bytes whose folded value is ``inside``.

    Works through the bytes piece by piece, cut between words, so that a long text takes no wide arrays.
    """
    starts, ends, hashes = [], [], []
    i, n = 0, len(data)
    while i < n:
        j = min(n, i + WORD_TABLE_BYTES)
        while j < n and j not in at:  # to a byte outside any word
            gap = np.flatnonzero(~inside[fold[data[j : j + 4096]]])
            if len(gap):
                j += int(gap[0])
                break
            j = min(n, j + 4096)
        part = fold[data[i:j]]
        edge = at[np.searchsorted(at, i, "left") : np.searchsorted(at, j, "right")] - i
        s, e = spans(inside[part], edge)
        hashes.append(span_hashes(prefix_sums(part), s, e))
        starts.append(s + i)
        ends.append(e + i)
        i = j
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.concatenate([np.zeros(0, np.uint64), *hashes])


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that nothing refers to any more."""
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
