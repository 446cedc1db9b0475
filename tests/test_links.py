import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import links
from folioscope.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_buttons(spark):
    b = spark.createDataFrame([("w", 1, "Book.xlsm!Module1.Go", "x"), ("w", 2, None, "Go now"), ("v", 3, " ", "Run all"), ("v", 4, "", "Running"), ("v", 5, "Gone", None)], "workbook string, id int, assigned string, label string")
    m = spark.createDataFrame([("w", "go"), ("w", "Other"), ("v", "Run")], "workbook string, macro string")
    assert rows(links.buttons_to_macros(b, m)) == [("v", 3, "Run"), ("v", 4, None), ("v", 5, None), ("w", 1, "go"), ("w", 2, None)]


def test_recordings(spark):
    f = spark.createDataFrame([("Deck – slide 2.mp4",), ("deck-Slide 02 .mp4",), ("a/deck slide 2.mov",), ("slide 3.mp4",), ("Other - slide 1.mp4",), ("notes.txt",)], "name string")
    s = spark.createDataFrame([("Deck", 1), ("Deck", 2), ("Deck", 3)], "stem string, slide int")
    assert rows(links.recordings_to_slides(f, s)) == [("Deck", 2, "Deck – slide 2.mp4"), ("Deck", 3, "slide 3.mp4")]


def test_lettering(spark):
    a = spark.createDataFrame([(1, "a", "RED", 0, 5, 5), (1, "b", "red", 1, 0, 5), (1, "c", "Red", 2, 5, 5), (1, "d", "red", 3, 5, 5)], "page int, id string, colour string, ord int, w int, h int")
    o = spark.createDataFrame([(1, "x", "red", 0), (1, "y", "blue", 1), (1, "z", "reD", 2)], "page int, id string, colour string, ord int")
    assert rows(links.lettering_to_outlines(a, o, ["page"])) == [(1, "a", "x"), (1, "b", None), (1, "c", "z"), (1, "d", None)]


def test_wrap(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 100.0, 30.0), (1, 2, 10.0, 10.0, 0.0, 100.0, 30.0)], "box int, id int, top double, height double, x double, w double, narrow double")
    near = spark.createDataFrame([(1, 0.0, 20.0, 0.0, 15.0)], "box int, left double, right double, top double, bottom double")
    assert rows(links.wrapped(spans, near, ["box"])) == [(1, 1, 23.6, 0.0), (1, 2, 0.0, 0.0)]
    assert len(links.text_indents(pd.DataFrame(columns=["id", "top", "height", "x", "w", "narrow"]), pd.DataFrame())) == 0


def test_wide_pictures_and_own_indents():
    spans = pd.DataFrame([(1, 0.0, 10.0, 0.0, 100.0, 10.0, 5.0)], columns=["id", "top", "height", "x", "w", "narrow", "own_left"])
    box = lambda *v: pd.DataFrame([v], columns=["left", "right", "top", "bottom"])
    assert links.text_indents(spans, box(0.0, 20.0, 0.0, 5.0))["left"].tolist() == [pytest.approx(18.6)]
    assert links.text_indents(spans, box(0.0, 60.0, 0.0, 5.0)).iloc[0].tolist() == [1.0, 0.0, 0.0]
    assert links.text_indents(spans, box(70.0, 90.0, 0.0, 5.0))["right"].tolist() == [pytest.approx(33.6)]
    assert links.text_indents(spans, box(70.0, 90.0, 50.0, 60.0))["right"].tolist() == [0.0]


def test_wrapping_that_does_not_settle_keeps_both_rounds():
    """Narrow, the first span pushes the second away from the picture beside it; wide, it does not."""
    spans = pd.DataFrame([(1, 0.0, 10.0, 0.0, 100.0, 40.0), (2, 10.0, 10.0, 0.0, 100.0, 10.0)], columns=["id", "top", "height", "x", "w", "narrow"])
    near = pd.DataFrame([(0.0, 20.0, 5.0, 15.0)], columns=["left", "right", "top", "bottom"])
    assert links.text_indents(spans, near, most_rounds=1)["left"].tolist() == [pytest.approx(23.6)] * 2


def test_clips_and_copies(spark):
    p = spark.createDataFrame([("d", "s1", "pic", "r1", "r2"), ("d", "s1", "no", "r2", "r2")], "package string, part string, id string, rid string, poster_rid string")
    r = spark.createDataFrame([("d", "s1", "r1", False, "ppt/media/m.MP3"), ("d", "s1", "r2", False, "ppt/media/p.png")], "package string, owner string, id string, external boolean, resolved string")
    out = links.clips(p, r).first()
    assert (out.media, out.poster, out.kind) == ("ppt/media/m.MP3", "ppt/media/p.png", "audio")
    a = spark.createDataFrame([("d", "x", ["m1", "m2"])], "deck string, asset string, parts array<string>")
    c = spark.createDataFrame([("d", "x", "file9")], "deck string, asset string, copy string")
    assert rows(links.saved_copies(a, c)) == [("d", "x", "m1", "file9"), ("d", "x", "m2", "file9")]


def test_sinks(spark, tmp_path):
    reports = spark.createDataFrame([("a", 3, None, {"secret": 1})], "document string, pages int, fonts int, tokens map<string,int>")
    sinks.write_reports(reports, str(tmp_path / "r"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()] == [{"document": "a", "pages": 3}]
    m = spark.createDataFrame([("a", [("c", "private words", 1, "e")])], "document string, warnings array<struct<code:string,message:string,page:int,element:string>>")
    assert "private" not in str(sinks.redacted(m).first())
    assets = spark.createDataFrame([("image", "image/png", "a.png", b"x"), ("image", "image/tiff", "b.tif", b"x"), ("video", "video/mp4", "c.mp4", None)], "kind string, mime string, file_name string, content binary")
    assert sinks.write_at_risk(assets, str(tmp_path / "c")) == {"written": 1, "left_out": 1, "failed": 1}
    assert spark.read.parquet(str(tmp_path / "c")).select(F.col("file_name")).first()[0] == "b.tif"
