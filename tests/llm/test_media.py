import sys
import time

import numpy as np
import pytest

from folioscope.llm import jpeg as J
from folioscope.llm import media as M

from .conftest import ROWS

PAYLOADS = [b"", b"\xc3\x80" * 31 + b"\xc3\x81" + b"\x7f" * 3, bytes(range(256)) * 3, b"\x80" * 200 + b"\x81", "À".encode() * 200 + b"x", b"\x7f\x80\x81\x82" * 50, b"a" * 70_000, np.random.default_rng(1).integers(126, 131, 5000).astype(np.uint8).tobytes()]


def test_every_payload_comes_back():
    padded = [M.payload_of(np.frombuffer(x, np.uint8)) for x in PAYLOADS]
    got = [p for p, _ in M._read(M.media_of(padded))]
    assert got == [p.tobytes() for p in padded]
    assert [len(p) for p in padded[:1]] == [64]


def test_another_decoder_sees_the_same_picture(spark):
    """Java's own JPEG reader, on pictures whose chroma is zero, so that ways to upsample do not matter."""
    rng = np.random.default_rng(5)
    for n in (1, 4, 24):
        blocks = np.zeros((6 * n, 64), np.int64)
        blocks[: 4 * n, :20] = rng.integers(-40, 41, (4 * n, 20))
        source = J.encode_images([blocks], [b"payload 0"])[0]
        images, coefficients = J.decode_coefficients([source])
        own = J.rgb_tensor(images[0], coefficients)
        jvm = spark.sparkContext._jvm
        read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(source))
        assert (read.getHeight(), read.getWidth()) == own.shape[:2]
        theirs = np.array([[[read.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(read.getWidth())] for y in range(read.getHeight())])
        assert np.abs(theirs - own).max() <= 2


def test_a_foreign_file_decodes(spark):
    """A progressive file of Java's writer: no restart markers, runs of empty blocks, scans of its own."""
    jvm = spark.sparkContext._jvm
    rng = np.random.default_rng(6)
    wide, high = 37, 29
    picture = jvm.java.awt.image.BufferedImage(wide, high, 5)
    smooth = np.clip(np.add.outer(np.linspace(0, 200, high), np.linspace(0, 50, wide)) + rng.integers(-9, 9, (high, wide)), 0, 255).astype(int)
    for y in range(high):
        for x in range(wide):
            picture.setRGB(x, y, int(smooth[y, x]) * 0x010101)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
    stream.close()
    source = bytes(out.toByteArray())
    images, coefficients = J.decode_coefficients([source])
    own = J.rgb_tensor(images[0], coefficients).astype(int)
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(source))
    theirs = np.array([[read.getRGB(x, y) >> 8 & 255 for x in range(wide)] for y in range(high)])
    assert len(images[0].scans) > 5 and images[0].scans[0].restart == 0
    assert np.abs(theirs - own[:, :, 1]).max() <= 3


def test_quantised_coefficients_and_samples():
    flat = np.zeros((1, 64), np.int64)
    flat[0, 0] = 80
    assert (J.samples(flat, np.full(64, 2)) == 128 + 20).all()
    with pytest.raises(ValueError, match="progressive"):
        J.parse(b"\xff\xd8\xff\xc0\x00\x04\x00\x00")


def test_documents(spark, sf, texts):
    import hashlib
    import zlib

    got = {r.doc_id: r for r in M.op2_media(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        p = M.payload_of(np.frombuffer(t.encode(), np.uint8)).tobytes()
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    same = {}
    for i, t in texts:
        assert same.setdefault(t, (got[i].media_sha256, got[i].feature)) == (got[i].media_sha256, got[i].feature)


def test_odd_rows(odd, none):
    media = M.media_column(odd)
    assert M.media_features(media).count() == len(ROWS) and M.media_features(M.media_column(none)).count() == 0
    tensors = M.media_tensors(media).collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in tensors) and len(tensors) == len(ROWS)
    from pyspark.sql import functions as F

    assert {r.rgb for r in M.media_tensors(media.withColumn("media", F.lit(None).cast("binary"))).collect()} == {None}


def test_null_and_damaged_media(spark):
    whole = M.media_of([M.payload_of(np.frombuffer(x, np.uint8)) for x in (b"one", b"two" * 50)])
    bad = [b"", b"not a picture", whole[1][:40], whole[1][: len(whole[1]) // 2], whole[0][:2] + b"\xff" * 30]
    rows = [(i, 3, None if m is None else bytearray(m), "x") for i, m in enumerate([whole[0], None, *bad, whole[1]])]
    df = spark.createDataFrame(rows, "id int, n_bytes bigint, media binary, height string").coalesce(1)
    got = {r.id: r for r in M.media_features(df).collect()}
    last = len(rows) - 1
    assert len(got) == len(rows) and got[0].payload_bytes == 64 and got[last].payload_bytes == 192
    assert (got[1].payload_bytes, got[1].media_bytes, got[1].feature) == (None, None, None)
    assert all(got[i].media_bytes == len(rows[i][2]) for i in range(2, last)) and got[2].feature is None and got[3].feature is None
    tensors = {r.id: r for r in M.media_tensors(df).collect()}
    assert tensors[0].rgb is not None and tensors[last].rgb is not None and tensors[1].rgb is None and tensors[3].height is None
    assert M.media_features(df.where("false")).count() == 0 and M.media_tensors(df.where("false")).count() == 0


def test_coding_takes_few_calls_for_an_image():
    """Short texts: what is done for each image in Python is counted, as it costs the same everywhere."""
    payloads = [M.payload_of(np.frombuffer(b"Some words of a short text. " * (1 + i % 90), np.uint8)) for i in range(300)]
    M.media_of(payloads[:1])  # tables
    calls = 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        read = list(M._read(M.media_of(payloads), M.features_of))
    finally:
        sys.setprofile(None)
    assert [p for p, _ in read] == [p.tobytes() for p in payloads]
    assert calls < 350 * len(payloads)  # 1 / 3 of the work was in these: some 560 an image


def test_short_way_gives_the_same_bytes_in_less_time():
    rng = np.random.default_rng(8)
    texts = [rng.integers(32, 123, 40_000), rng.integers(0, 256, 20_000), rng.choice([100, 127, 128, 129], 20_000, p=[0.97, 0.01, 0.01, 0.01]), np.full(6400, 128), np.frombuffer("ကခဂ က္ ".encode() * 500, np.uint8)]
    payloads = [M.payload_of(x.astype(np.uint8)) for x in texts]
    wide = [p.reshape(-1, 64).astype(np.int64) - 128 for p in payloads]
    names = [b"payload %d" % len(p) for p in payloads]
    assert M.media_of(payloads) == J.encode_images(wide, names)
    plain = [M.payload_of(rng.integers(32, 123, 500_000).astype(np.uint8))]
    plain_wide = [plain[0].reshape(-1, 64).astype(np.int64) - 128]

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert min(took(lambda: M.media_of(plain)) for _ in range(3)) < 0.7 * min(took(lambda: J.encode_images(plain_wide, [b""])) for _ in range(3))


def plain_tensor(image, coefficients):
    """One image, a block at a time, in double precision."""
    planes = []
    for c in image.components:
        plane = np.zeros((8 * image.mcus[1] * c.v, 8 * c.padded))
        for r in range(image.mcus[1] * c.v):
            for x in range(c.padded):
                block = coefficients[c.base + r * c.padded + x].astype(np.float64) * image.quantisers[c.table]
                plane[8 * r : 8 * r + 8, 8 * x : 8 * x + 8] = np.clip(np.floor((block @ J._BASIS + 4096) / 8192) + 128, 0, 255).reshape(8, 8)
        planes.append(np.kron(plane, np.ones((2, 2)) if c.h == 1 else np.ones((1, 1)))[: image.height, : image.width].astype(np.int64))
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + (91881 * r + 32768 >> 16), y - (22554 * b + 46802 * r + 32768 >> 16), y + (116130 * b + 32768 >> 16)], axis=2), 0, 255)


def plain_feature(tensor):
    height, width, _ = tensor.shape
    luma = tensor.astype(np.int64).sum(axis=2)
    steps = [sum(abs(int(luma[j + dj, i + di]) - int(luma[j, i])) for j in range(height - dj) for i in range(width - di)) for dj, di in ((0, 1), (1, 0))]
    means = [1000 * int(tensor[:, :, c].sum()) // (height * width) for c in range(3)]
    return f"{width}x{height} rgb {means[0]} {means[1]} {means[2]} steps {1000 * steps[0] // (height * width)} {1000 * steps[1] // (height * width)}"


def test_tensors_and_features_by_brute_force():
    """Many images at once: of one row of MCUs, of several, and of sizes that cut the last MCUs."""
    rng = np.random.default_rng(9)
    media = M.media_of([M.payload_of(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 30, 400, 401, 3000, 30_000, 26_000, 64)])
    frame = media[4].index(b"\xff\xc2")
    media.append(media[4][: frame + 5] + (9).to_bytes(2, "big") + (16 * 8 - 5).to_bytes(2, "big") + media[4][frame + 9 :])
    images, coefficients = J.decode_coefficients(media)
    expected = [plain_tensor(x, coefficients) for x in images]
    assert expected[-1].shape == (9, 123, 3)
    for a, b, x in zip(M.tensors_of(images, coefficients), expected, images, strict=True):
        assert np.array_equal(a, b) and np.array_equal(J.rgb_tensor(x, coefficients), b)
    assert M.features_of(images, coefficients) == [plain_feature(x) for x in expected]


def test_scans_of_no_component_and_no_band_are_damage():
    whole = M.media_of([M.payload_of(np.frombuffer(b"three" * 50, np.uint8))])[0]
    scan = whole.index(b"\xff\xda\x00\x08\x01")  # of one component
    bad = [whole[: scan + 5] + b"\x09" + whole[scan + 6 :], whole[: scan + 7] + b"\x05\x01" + whole[scan + 9 :], whole[: scan + 8] + b"\x40" + whole[scan + 9 :]]
    assert [x is None for x in M._read([*bad, whole])] == [True, True, True, False]
