import pytest
from pyspark.sql import functions as F

from folioscope.functions import measure, text
from folioscope.functions.evaluate import evaluate


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_tokens(spark):
    rows = ["well‑known well-known", "soft­hyphen", "a\x00b c", "a\x1cb\x85c\xa0d", "lost lost lost", None, ""]
    assert values(spark, text.tokens, rows) == [["well-known", "well-known"], ["softhyphen"], ["c"], ["a", "b", "c", "d"], ["lost"] * 3, [], []]


def test_spreadsheet_references(spark):
    refs = ["A1", "Z9", "AA10", "ZZZZ1", "a1", "A0", "A1:B2", "junk", "A1\n"]
    assert values(spark, text.reference_column, refs) == [1, 26, 27, 475254, None, None, None, None, None]
    assert values(spark, text.reference_row, refs) == [1, 9, 10, 1, None, None, None, None, None]
    assert [tuple(x) for x in values(spark, text.range_corner, ["A1:B2", "C3", "x"])] == [(2, 2), (3, 3), (0, 0)]
    df = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (18278,), (0,)], "n int")
    assert [r[0] for r in df.select(text.column_letters(F.col("n"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", ""]


def test_names(spark):
    assert values(spark, text.family_key, ['  "Times  New" ', "STRASSE", "straße"]) == ["times new", "strasse", "strasse"]
    assert values(spark, text.file_key, ["a\\b/C.XLSX", "C.xlsx"]) == ["c.xlsx", "c.xlsx"]
    assert values(spark, text.is_text_date, ["1/2/99", " 12.11.2020 ", "1/2/999", "x 1/2/99", "1/2/99\n"]) == [True, True, False, False, True]
    assert values(spark, text.utf16_length, ["a😀", "é"]) == [3, 1]
    assert values(spark, text.seconds_of, ["1h2m3s", "90", "90s", "", "x"]) == [3723, 90, 90, None, None]


def test_video_links(spark):
    rows = ["https://youtu.be/abcdefghijk?t=1m5s", "https://www.youtube.com/watch?v=abcdefghijk", "https://vimeo.com/12345", "https://example.com/watch?v=abcdefghijk"]
    assert [tuple(x) for x in values(spark, text.video_provider, rows)] == [("youtube", "abcdefghijk", 65), ("youtube", "abcdefghijk", None), ("vimeo", "12345", None), (None, None, None)]


@pytest.mark.parametrize(
    ("formula", "value"),
    [("1+#ppt_w/2", 2.0), ("-(-3)", 3.0), ("--3", 3.0), ("4/0", 0.0), ("#nope+1", 1.0), ("1+", None), ("(1", None), ("1)", None), ("", None), ("2*-3", -6.0), ("1-2-3", -4.0), ("2+3*4", 14.0), ("1 2", None), ("abc", None), (None, None)],
)
def test_evaluate(formula, value):
    assert evaluate(formula, {"ppt_w": 2.0}) == value


def test_measures(spark):
    df = spark.range(1)
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    assert df.select(measure.signed_area(square)).first()[0] == 4.0
    assert tuple(df.select(measure.bounds(square)).first()[0]) == (0.0, 0.0, 2.0, 2.0)
    assert [df.select(measure.half_even(F.lit(x))).first()[0] for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]
    a, b = (measure.box(*[F.lit(v) for v in box]) for box in ((0, 0, 10, 10), (1, 1, 9, 10)))
    assert [df.select(measure.contains(a, b, s)).first()[0] for s in (0, 1)] == [False, True]
    space = F.struct(*[F.lit(float(v)).alias(k) for k, v in (("sx", 1), ("sy", 1), ("dx", 0), ("dy", 0))])
    pair = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    assert tuple(df.select(measure.in_group(space, pair(10, 10), pair(100, 100), pair(0, 0), pair(50, 0))).first()[0]) == (2.0, 1.0, 10.0, 10.0)
