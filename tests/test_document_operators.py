import pandas as pd
from pyspark.sql import functions as F

from folioscope.operators import assets, fields, fonts, layout, readback


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_fonts(spark):
    names = [' "Arial" ', "calibri", "ARIMO", "aptos", "Twinkl", "Nope", "Arial,Sans-Serif", "Rockwell, serif", "Nope, Arial", "  ", "Segoe  UI", "segoe ui"]
    out = {r.family: (r.status, r.replacement, r.confidence, r.manual_review) for r in fonts.compatibility(spark.createDataFrame([(n,) for n in names], "family string")).collect()}
    assert out == {
        '"Arial"': ("AVAILABLE", None, "high", False),
        "calibri": ("AVAILABLE", None, "high", False),
        "ARIMO": ("AVAILABLE", "Arimo", "high", False),
        "aptos": ("SUBSTITUTED", "Carlito", "medium", False),
        "Twinkl": ("SUBSTITUTED", "Andika", "low", True),
        "Nope": ("UNKNOWN", None, None, True),
        "Arial,Sans-Serif": ("SUBSTITUTED", "Arial", "high", False),
        "Rockwell, serif": ("SUBSTITUTED", "Roboto Slab", "medium", False),
        "Nope, Arial": ("UNKNOWN", None, None, True),
        "Segoe UI": ("SUBSTITUTED", "Inter", "medium", False),
    }


def reference_cached(marks):
    stack, out = [], []
    for o, kind, text in marks:
        if kind == "begin":
            stack.append(["", False])
        elif kind == "separate" and stack:
            stack[-1][1] = True
        elif kind == "end" and stack:
            stack.pop()
        elif kind == "instr" and stack:
            stack[-1][0] += text
        elif kind == "text" and any(r and i.strip().lstrip("\\").strip().split(" ")[0].upper() in fields.REGENERATED for i, r in stack):
            out.append(o)
    return out


def test_fields(spark):
    import random

    rng = random.Random(4)
    marks, want = [], []
    for part in range(25):
        own = []
        depth = []
        for o in range(60):
            kind = rng.choice(["begin", "instr", "separate", "text", "text", "end"])
            if kind == "separate" and not (depth and not depth[-1]):
                kind = "text"
            if kind == "instr" and not (depth and not depth[-1]):
                kind = "text"
            if kind == "begin":
                depth.append(False)
            elif kind == "separate":
                depth[-1] = True
            elif kind == "end" and depth:
                depth.pop()
            own.append((o, kind, rng.choice(["TOC \\o", " PAGE ", "REF x", "HYPERLINK"]) if kind == "instr" else "t"))
        marks += [(part, *m) for m in own]
        want += [(part, o) for o in reference_cached(own)]
    df = spark.createDataFrame(marks, "part int, ord int, kind string, text string")
    assert rows(fields.cached_texts(df)) == sorted(want, key=str)


def test_asset_names(spark):
    df = spark.createDataFrame(
        [("Deck", "a", 0, "image", "Picture 3", "image/png", [2]), ("Deck", "b", 1, "image", "Sunset.png", "image/png", [1, 2, 3, 10]), ("Deck", "c", 2, "video", "sunset", "video/mp4", [3, 1]), ("Deck", "d", 3, "image", None, "image/x-odd", None)],
        "deck string, id string, ord int, kind string, name string, mime string, slides array<int>",
    )
    assert {r.id: r.file_name for r in assets.named(df).collect()} == {
        "a": "Deck – slide 02 – image 2.png",
        "b": "Deck – slides 01 and 3 more – Sunset.png",
        "c": "Deck – slides 01, 03 – sunset (2).mp4",
        "d": "Deck – image 3.bin",
    }


def test_pictures(spark):
    df = spark.createDataFrame([("image/png", 1000, 500, 500.0, 200.0, False), ("image/png", 1000, 500, 950.0, 100.0, False), ("image/gif", 1, 1, 1.0, 1.0, False), ("image/png", None, 1, 1.0, 1.0, False), ("image/png", 10, 10, None, None, True)], "mime string, width int, height int, needed_width double, needed_height double, unknown boolean")
    assert [(r.reason, r.scale) for r in assets.picture_plan(df).collect()] == [(None, 0.5), ("already_small", 1.0), ("format", 1.0), ("unreadable", 1.0), ("size_unknown", 1.0)]


def test_side_by_side_is_greedy(spark):
    df = spark.createDataFrame([(1, i, 10.0 * i, 0.0, 8.0, 5.0) for i in range(5)] + [(1, 9, 0.0, 50.0, 5.0, 5.0)], "p int, id int, x double, y double, w double, h double")
    assert rows(layout.side_by_side(df, ["p"]), "left", "right") == [(0, 1), (2, 3)]


def test_bands_to_rows_is_all_or_nothing(spark):
    cols = spark.createDataFrame([(t, c, 100 * c, 100 * c + 100) for t in (1, 2) for c in (0, 1)], "t int, col int, left int, right int")
    free = spark.createDataFrame([(t, 0, r) for t in (1, 2) for r in (3, 5)], "t int, col int, row int")
    pictures = spark.createDataFrame([(1, 1, 10, 0, 50), (1, 2, 20, 1_000_000, 50), (2, 3, 10, 0, 50), (2, 4, 60, 1_000_000, 80)], "t int, id int, x int, y int, w int")
    assert rows(layout.bands_to_rows(pictures, cols, free, ["t"]), "t", "id", "col", "row") == [(1, 1, 0, 3), (1, 2, 0, 5)]


def test_stills_are_used_once(spark):
    box = "s int, id int, ord int, x double, y double, w double, h double"
    videos = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 9.0), (1, 2, 1, 1.0, 0.0, 9.0, 9.0)], box)
    pictures = spark.createDataFrame([(1, 7, 0, 1.0, 0.0, 9.0, 9.0), (1, 8, 1, 3.0, 0.0, 9.0, 9.0), (1, 9, 2, 30.0, 0.0, 9.0, 9.0)], box)
    assert rows(layout.matched_stills(videos, pictures, ["s"])) == [(1, 1, 7), (1, 2, 8)]
    assert layout.assigned([1.0, 2.0], [2.0, 1.0], 0.05) == [1, 0] and layout.assigned([1.0], [1.0, 2.0], 0.1) is None and layout.assigned([1.0, 1.0], [5.0, 1.0], 0.1) is None and layout.assigned([float(k) for k in range(1, 8)], [float(k) for k in range(7, 0, -1)], 0.1) is None
    assert len(layout.nearest_stills(pd.DataFrame(columns=["id", "ord", "x", "y", "w", "h"]), pd.DataFrame(columns=["id", "ord", "x", "y", "w", "h"]))) == 0


def test_page_relation(spark):
    marks = spark.createDataFrame([("d", 0, 0, 0, 0, False), ("d", 1, 0, 0, 0, False), ("d", 2, 1, 0, 0, False), ("d", 3, 0, 0, 1, False), ("d", 4, 0, 0, 0, False), ("d", 5, 0, 0, 0, False), ("d", 6, 0, 0, 0, False), ("d", 7, 0, 0, 0, False), ("d", 8, 0, 0, 0, False)], "k string, place int, inside int, before int, ends int, rendered boolean")
    pairs = spark.createDataFrame([("d", 0, 1), ("d", 0, 3), ("d", 1, 2), ("d", 2, 2), ("d", 3, 4), ("d", 4, 8), ("d", 4, 7)], "k string, a int, b int")
    assert {(r.a, r.b): r.relation for r in layout.page_relation(pairs, marks, "k").collect()} == {(0, 1): "same", (0, 3): "different", (1, 2): "unknown", (2, 2): "unknown", (3, 4): "different", (4, 8): "unknown", (4, 7): "same"}


def test_room_and_order(spark):
    df = spark.createDataFrame([(1, "t", "table", 0.0, 10.0, 50.0, 20.0), (1, "b", "text", 10.0, 60.0, 10.0, 10.0), (1, "far", "text", 90.0, 40.0, 10.0, 10.0)], "p int, id string, kind string, x double, y double, w double, h double")
    assert rows(layout.room_below(df, ["p"], F.lit(200.0)), "id", "room") == [("t", 48.0)]
    slots = spark.createDataFrame([(1, 0, "a", "f", 5, 9), (1, 1, "b", "f", 5, 1), (2, 0, "c", "f", 1, 9), (2, 1, "d", "g", 1, 1)], "p int, slot int, id string, frame string, x int, y int")
    assert rows(layout.reading_order(slots, ["p"])) == [(1, 0, "b"), (1, 1, "a"), (2, 0, "c"), (2, 1, "d")]


def test_readback(spark):
    deck = "deck int, position int, width double, height double, n_images int, n_tables int, n_charts int, missing_tokens int"
    a = spark.createDataFrame([(1, 1, 10.0, 5.0, 2, 0, 0, 0), (1, 2, 10.0, 5.0, 0, 1, 0, 0)], deck)
    b = spark.createDataFrame([(1, 1, 10.05, 5.2, 1, 0, 0, 3)], deck)
    assert rows(readback.deck_findings(a, b)) == [(1, "content_changed", 1), (1, "images_missing", 1), (1, "page_size_changed", 1), (1, "slide_missing", 2)]
    planned = spark.createDataFrame([(1, "x", "a b"), (1, "y", "q"), (1, "z", "m")], "slide int, id string, text string")
    found = spark.createDataFrame([(1, "x", "ab"), (1, "y", "other")], "slide int, id string, text string")
    assert rows(readback.object_findings(planned, found)) == [(1, "y", "text_differs"), (1, "z", "object_missing")]
    facts = spark.createDataFrame([(1, 2, 0, 0, 1, 0, None, 3, 0, 0, 9)], "id int, missing_tokens int, equations int, source_fields int, blank_pages int, floating_pictures int, source_tables int, tables int, page_break_paragraphs int, source_pages int, pages int")
    assert [r.code for r in readback.document_findings(facts).orderBy("seq").collect()] == ["content_changed", "blank_pages"]
    sizes = spark.createDataFrame([("docx", 51 << 20), ("docx", 50 << 20), ("pub", 1 << 40)], "f string, n long")
    assert [r[0] for r in sizes.select(readback.over_import_limit(F.col("f"), F.col("n"))).collect()] == [True, False, False]
