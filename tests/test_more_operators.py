import struct

import pytest
from pyspark.sql import functions as F

from folioscope.functions import measure as M
from folioscope.operators import textfit, transforms
from folioscope.sources import compound


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def points(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_lengths(spark):
    df = spark.createDataFrame([("0.39in",), ("12pt",), ("115%",), ("240",), ("x",), ("5 furlongs",), (None,)], "t string")
    assert [None if r[0] is None else round(r[0], 2) for r in df.select(M.length_in_points(F.col("t"))).collect()] == [28.08, 12.0, None, 12.0, None, None, None]
    assert [r[0] for r in df.select(M.percentage(F.col("t"))).collect()] == [None, None, 115.0, None, None, None, None]


def test_motion(spark):
    ease = lambda p, a, d: round(one(spark, M.eased(F.lit(p), F.lit(a), F.lit(d))), 6)
    assert [ease(x, 0.0, 0.0) for x in (0.0, 0.3, 1.0)] == [0.0, 0.3, 1.0]
    assert ease(0.0, 0.5, 0.5) == 0.0 and ease(0.5, 0.5, 0.5) == 0.5 and ease(1.0, 0.5, 0.5) == 1.0 and ease(0.2, 0.2, 0.0) == pytest.approx(0.111111) and ease(1.7, 0.5, 0.5) == 1.0 and ease(-3.0, 0.0, 0.0) == 0.0
    assert tuple(one(spark, M.point_along(points((0, 0), (10, 0), (10, 10)), F.lit(0.75)))) == (10.0, 5.0)
    assert tuple(one(spark, M.point_along(points((0, 0), (10, 0)), F.lit(1.0)))) == (10.0, 0.0)
    frames = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(v).alias("value")) for a, v in ((0.2, 1.0), (0.6, 3.0))])
    assert [one(spark, M.keyframe_value(frames, F.lit(t))) for t in (0.0, 0.4, 0.9)] == [1.0, pytest.approx(2.0), 3.0]


def test_frames(spark):
    f = one(spark, M.frame_of_outline(points((0, 0), (0, 4), (-2, 4), (-2, 0))))
    assert (f.cx, f.cy, f.w, f.h, f.rotation) == (-1.0, 2.0, 4.0, 2.0, 90.0)
    back = one(spark, M.outline_of_frame(F.struct(*[F.lit(float(v)).alias(k) for k, v in f.asDict().items()])))
    assert [(round(p.x, 9), round(p.y, 9)) for p in back] == [(0, 0), (0, 4), (-2, 4), (-2, 0)]
    place = lambda frame, align, off: one(spark, M.paper_offset(F.lit(frame), F.lit(align), F.lit(off), F.lit(10), F.lit(100), F.lit(20), F.lit(30)))
    assert [place("page", None, 7), place("margin", "center", None), place("right_margin", "right", None), place("inside", None, 1), place("margin", "inside", 1)] == [7, 40, 90, None, None]
    assert one(spark, M.shrunk(F.array(F.lit(50.0), F.lit(150.0), F.lit(0.0)), F.lit(100.0))) == [25, 75, 1]


def test_block_rules(spark):
    blocks = spark.createDataFrame([(1, i, k) for i, k in enumerate(["text", "picture", "picture", "table", "empty", "table", "picture", "text", "picture", "table", "empty"])], "d int, ord int, kind string")
    assert sorted(tuple(r) for r in transforms.pictures_above(blocks, ["d"]).collect()) == [(1, 1, 3), (1, 2, 3), (1, 8, 9)]
    assert [r.ord for r in transforms.empty_between_tables(blocks, ["d"]).where("between_tables").collect()] == [4]
    lists = spark.createDataFrame([(1, 0, "a", 3, 4), (1, 1, "a", 3, None), (1, 2, "a", 0, None), (1, 3, "a", 2, None), (1, 4, "b", 2, 7), (1, 5, None, 2, None)], "d int, ord int, preset string, length int, start int")
    assert [(r.run, r.restart_note) for r in transforms.list_numbers(lists, ["d"]).orderBy("ord").collect()] == [(1, True), (1, False), (None, False), (2, False), (3, False), (None, False)]
    cells = spark.createDataFrame([(1, 0, True, 900.0), (1, 1, True, 90.0), (1, 2, False, 5.0), (1, 3, True, None)], "t int, row int, gained boolean, picture_height double")
    assert sorted(r.row for r in transforms.protected_rows(cells, ["t"], F.lit(500.0)).collect()) == [1, 3]
    said = spark.createDataFrame([(1, 0, None, True), (1, 1, False, True), (2, 0, None, True), (3, 0, None, None)], "b int, ord int, rtl boolean, anchor boolean")
    assert {r.b: r.right_to_left for r in transforms.direction(said, ["b"], F.col("anchor")).collect()} == {1: False, 2: True, 3: False}


def test_groups(spark):
    e = spark.createDataFrame([(1, "a", "L", "shape", 0.0, 0.0, 100.0, 100.0), (1, "b", "L", "shape", 10.0, 10.0, 92.0, 5.0), (1, "c", "M", "shape", 0.0, 0.0, 100.0, 100.0), (1, "d", "M", "shape", 50.0, 0.0, 90.0, 9.0)], "p int, id string, parent string, kind string, x double, y double, w double, h double")
    assert {r.layer: r.authored for r in transforms.authored_groups(e, ["p"]).collect()} == {"L": False, "M": True}
    clip = e.withColumn("clip", F.lit(False)).unionByName(spark.createDataFrame([(1, "M", "M0", "layer", 0.0, 0.0, 9.0, 9.0, True)], "p int, id string, parent string, kind string, x double, y double, w double, h double, clip boolean"))
    assert {r.layer: r.authored for r in transforms.authored_groups(clip, ["p"]).collect()} == {"L": False, "M": False, "M0": True}
    m = spark.createDataFrame([(1, "g", "a", "shape"), (1, "g", "b", "text"), (1, "h", "c", "shape"), (1, "h", "d", "table"), (1, "k", "e", "shape")], "p int, group string, id string, kind string")
    assert [(r.group, r.members) for r in transforms.kept_groups(m, ["p"]).collect()] == [("g", ["a", "b"])]


def test_fit(spark):
    wide = dict.fromkeys("abc ", 0.5)
    assert textfit.wrapped_lines("aa bb cc", 10, 25, wide) == 2 and textfit.wrapped_lines("aaaaaa", 10, 12, wide) == 3 and textfit.wrapped_lines("z", 10, 12, wide) is None
    assert textfit.fit([("aa", 10)], 50, 30, wide) == (100, 1.0, False)
    assert textfit.fit([("aa", 10), ("aa", 10)], 50, 30, wide) == (90, 1.0, False)
    assert textfit.fit([("aa", 10)] * 9, 50, 30, wide) == (90, 0.75, True)
    df = spark.createDataFrame([(1, 50.0, 30.0, [("aa", 10.0)]), (2, 50.0, 30.0, [("q", 10.0)])], "id bigint, width double, height double, paragraphs array<struct<text:string,size:double>>")
    assert sorted(textfit.fitted(df, wide).collect(), key=lambda r: r.id) == [(1, 100, 1.0, False), (2, None, None, None)]


def container(text):
    """A compressed container of literals only."""
    out = b"\1"
    for i in range(0, len(text), 3600):
        part = text[i : i + 3600]
        chunk = b"".join(b"\0" + part[k : k + 8] for k in range(0, len(part), 8))
        out += struct.pack("<H", 0xB000 | (len(chunk) - 1)) + chunk
    return out


def compound_file(named):
    """Every stream in whole sectors, all of them long enough for the ordinary table."""
    size, end, free = 512, 0xFFFFFFFE, 0xFFFFFFFF
    body, table, entries = [], [], []

    def stored(data):
        n = max(1, -(-len(data) // size))
        start = len(body)
        for k in range(n):
            body.append(data[k * size : (k + 1) * size].ljust(size, b"\0"))
            table.append(start + k + 1 if k < n - 1 else end)
        return start

    def entry(name, kind, left, right, child, start, length):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<3I", left, right, child) + b"\0" * 36 + struct.pack("<II", start, length) + b"\0" * 4

    names = list(named)
    entries.append(entry("Root Entry", 5, free, free, 1, end, 0))
    entries.append(entry("VBA", 1, free, free, 2, 0, 0))
    for k, n in enumerate(names):
        data = named[n].ljust(4096, b"\0") if len(named[n]) < 4096 else named[n]
        entries.append(entry(n, 2, free, 3 + k if k < len(names) - 1 else free, free, stored(data), len(data)))
    directory = stored(b"".join(entries))
    fat = len(body)
    table.append(0xFFFFFFFD)
    body.append(struct.pack("<128I", *table, *[free] * (128 - len(table))))
    head = compound.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<III", 0, 1, directory) + struct.pack("<I", 0) + struct.pack("<I", 4096) + struct.pack("<IIII", end, 0, end, 0)
    return head + struct.pack("<109I", fat, *[free] * 108) + b"".join(body)


def test_compound_files(spark):
    record = lambda tag, body: struct.pack("<HI", tag, len(body)) + body
    info = record(3, struct.pack("<H", 1252)) + record(0x19, b"Module1") + record(0x1A, b"Module1") + record(0x31, struct.pack("<I", 7)) + record(0x21, b"") + record(0x2B, b"")
    source = 'Sub Go()\r\n  x = 1 _\r\n   + 2\r\n  \' note\r\nEnd Sub\r\nSub With(a)\r\nEnd Sub\r\nSub Open_()\r\n y = 2\r\n'
    data = compound_file({"dir": container(info), "Module1": b"skipped" + container(source.encode())})
    (name, kind, text), = compound.macro_modules(data)
    assert (name, kind) == ("Module1", "standard") and text.startswith(source)
    assert compound.macros(source) == [("Go", 1, True), ("Open_", 1, False)]
    df = spark.createDataFrame([("a", data), ("b", b"junk"), ("c", data[:700])], "path string, content binary")
    out = {r.path: r for r in compound.modules(df).collect()}
    assert out["a"].module == "Module1" and out["b"].error.startswith("damaged") and out["c"].error.startswith("damaged")
    with pytest.raises(compound.DamagedFile):
        list(compound._chain([1, 0], 0))


def test_compressed_copies():
    # Three literals, then a copy of nine bytes from three back.
    assert compound.decompressed(b"\1" + struct.pack("<H", 0xB000 | 5) + b"\x08abc" + struct.pack("<H", (2 << 12) | 6)) == b"abc" * 4
