import pytest

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog and then it sleeps for a very long while.", "en", "src0"),
    (1, "The quick brown fox jumps over the lazy dog and then it sleeps for a very long while.", "en", "src0"),
    (1, "The quick brown fox jumps over the lazy dog and then it sleeps for a very long while.", "en", "src0"),
    (2, None, "en", None),
    (3, "", None, "src1"),
    (4, "  \n\t ", "fr", "src1"),
    (5, "èéê " * 60, "fr", "src1"),
    (6, "one two", "en", "src2"),
    (7, "x" * 500, "en", "src2"),
    (8, "prefix " + "The quick brown fox jumps over the lazy dog and then it sleeps for a very long while." + " suffix", "en", "src2"),
    (9, "語" * 200 + "😀\x00▁<|im_end|>", "zh", "src3"),
    (None, "The quick brown fox jumps over the lazy dog and then it sleeps for a very long while.", "en", "src3"),
    (-5, "12345 67890 !!!", "de", "src3"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    docs = spark.createDataFrame([(*r, 1, "c", True) for r in ROWS], "doc_id bigint, text string, lang string, source string, row int, part string, id boolean")
    return docs.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
