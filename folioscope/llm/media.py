"""Media columns: progressive JPEGs that hold payloads without loss, and RGB tensors and features read from them.

A payload's bytes are DCT coefficients of 8-bit range, 64 to a block: the format's own unit, which its entropy coding
keeps exactly. Reading accumulates the scans into coefficients again; the inverse transform, chroma upsampling and
colour conversion give the tensor.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, one_thread, read
from .jpeg import Image, decode_coefficients, encode_images, rgb_strips

#: Bytes of text, and of media, that are coded together.
BATCH_BYTES = 1 << 20
UNIT = 64


def payload_of(data: np.ndarray) -> np.ndarray:
    """The bytes, with bytes 0 up to a positive multiple of UNIT."""
    out = np.zeros(max(UNIT, -(-len(data) // UNIT) * UNIT), np.uint8)
    out[: len(data)] = data
    return out


def media_of(payloads: list[np.ndarray]) -> list[bytes]:
    return encode_images([(p.reshape(-1, UNIT) ^ np.uint8(128)).view(np.int8) for p in payloads], [b"payload %d" % len(p) for p in payloads])


def media_column(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media) for each row: the text's UTF-8 bytes as a progressive JPEG. Null counts as empty.

    Equal texts have equal media; repeated rows give repeated rows; other columns are not read; an empty table gives no
    rows. A text is never cut: a longer one makes a larger image, up to what a Python worker holds some fifty times over.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text", BATCH_BYTES):
            edges = at.tolist()
            media = media_of([payload_of(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(work, f"id {kind}, n_bytes bigint, media binary")


def tensors_of(images: list[Image], coefficients: np.ndarray) -> list[np.ndarray]:
    """The RGB tensor of each image: (height, width, 3)."""
    found = {}
    for strip in rgb_strips(images, coefficients):
        for i, left, width in zip(strip.images, strip.left, strip.width, strict=True):
            found[i] = np.stack([p[:, left : left + width] for p in strip.planes], axis=2)
    return [found[i] for i in range(len(images))]


def features_of(images: list[Image], coefficients: np.ndarray) -> list[str]:
    """Size, channel means and mean steps between neighbours of each image's tensor, in whole thousandths."""
    found = {}
    for strip in rgb_strips(images, coefficients):
        luma = np.add(strip.planes[0], strip.planes[1], dtype=np.int16)
        luma += strip.planes[2]
        across, down = np.abs(luma[:, 1:] - luma[:, :-1]), np.abs(luma[1:] - luma[:-1])
        # Sums over all columns before each: an image's is a difference of two.
        sums = [np.concatenate(([0], np.cumsum(x.sum(axis=0, dtype=np.int64)))).tolist() for x in (*strip.planes, across, down)]
        height = len(luma)
        for i, left, width in zip(strip.images, strip.left, strip.width, strict=True):
            ends = [left + width] * 3 + [left + max(0, width - 1), left + width]
            a = [1000 * (x[end] - x[left]) // max(1, height * width) for x, end in zip(sums, ends, strict=True)]
            found[i] = f"{width}x{height} rgb {a[0]} {a[1]} {a[2]} steps {a[3]} {a[4]}"
    return [found[i] for i in range(len(images))]


#: What decoding raises on damaged files.
DAMAGE = (ArithmeticError, LookupError, TypeError, ValueError)


def _decoded(media: list[bytes], seen: Callable[[list[Image], np.ndarray], list]) -> list[tuple[bytes, object]]:
    images, coefficients = decode_coefficients(media)
    out = []
    for image, view in zip(images, seen(images, coefficients), strict=True):
        n = int(image.comment.removeprefix(b"payload ")) // UNIT if image.comment.startswith(b"payload ") else 0
        base = image.components[0].base
        out.append(((coefficients[base : base + n].astype(np.uint8) ^ np.uint8(128)).tobytes(), view))
    return out


def _read(media: list[bytes | None], seen: Callable[[list[Image], np.ndarray], list] = tensors_of) -> Iterator[tuple[bytes, object] | None]:
    """Payload, and tensor or feature, of each image; nothing for nulls and for files that cannot be decoded."""
    known = [m for m in media if m is not None]
    try:
        whole = iter(_decoded(known, seen) if known else [])
    except DAMAGE:
        whole = None  # one by one, then
    for m in media:
        found = None
        if m is not None:
            try:
                found = next(whole) if whole is not None else _decoded([m], seen)[0]
            except DAMAGE:
                found = None
        yield found


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    media, i = batch.column(column), 0
    while i < batch.num_rows:
        own, size = [], 0
        while i + len(own) < batch.num_rows and (not own or size < 2 * BATCH_BYTES):
            own.append(media[i + len(own)].as_py())
            size += len(own[-1] or b"")
        yield batch.slice(i, len(own)), own
        i += len(own)


def media_tensors(media: DataFrame, id_col: str = "id", column: str = "media") -> DataFrame:
    """(id, height, width, rgb) for each row: full-resolution RGB samples, row by row. Null and damaged media give nulls.

    Repeated rows give repeated rows; other columns are not read; an empty table gives no rows. An image must fit in a
    Python worker's memory some twenty times over, uncompressed.
    """
    kind = dict(media.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for rows, own in _groups(batch, 1):
                tensors = [None if x is None else x[1] for x in _read(own)]
                shape = lambda k: pa.array([None if t is None else t.shape[k] for t in tensors], pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([rows.column(0), shape(0), shape(1), pa.array([None if t is None else t.tobytes() for t in tensors], pa.binary())], ["id", "height", "width", "rgb"])

    return media.select(F.col(id_col).alias("id"), F.col(column).alias("media")).mapInArrow(work, f"id {kind}, height int, width int, rgb binary")


READ = "id {}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_features(media: DataFrame, id_col: str = "id") -> DataFrame:
    """What the media of media_column() holds, read back from its bytes, and features of its tensor. Repeated rows give repeated rows.

    Null media gives nulls; damaged media only its size and digest. Other columns are not read; an empty table gives no
    rows; texts as long as in media_column().
    """
    kind = dict(media.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for rows, own in _groups(batch, 2):
                found = [(None,) * 4 if x is None else (len(x[0]), hashlib.sha256(x[0]).hexdigest(), zlib.crc32(x[0][-UNIT:]), x[1]) for x in _read(own, features_of)]
                size, digest, tail, feature = (list(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(tail, pa.int64()), pa.array([None if m is None else len(m) for m in own], pa.int64()), pa.array([None if m is None else hashlib.sha256(m).hexdigest() for m in own], pa.string()), pa.array(feature, pa.string())],
                    ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(work, READ.format(kind))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as media, and what is read back from it."""
    return media_features(media_column(read(spark, sf_dir, "documents").select("doc_id", "text"))).withColumnRenamed("id", "doc_id")
