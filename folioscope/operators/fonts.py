"""Font families: what is available, what stands in for what, and the notes that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import family_key, list_head

# Families that the target has itself.
NATIVE = (
    "Arial", "Arial MT", "Book Antiqua", "Calibri", "Calibri Light", "Cambria", "Cambria Math", "Century Gothic", "Comic Sans MS", "Consolas", "Courier New", "Franklin Gothic",
    "Franklin Gothic Medium", "Garamond", "Georgia", "Impact", "Palatino Linotype", "Tahoma", "Times New Roman", "Times New Roman PS MT", "Trebuchet MS", "Verdana",
)
# Families of the open catalogue that are known to be there.
CURATED = (
    "Andika", "Anton", "Arimo", "Atkinson Hyperlegible", "Caladea", "Carlito", "Caveat", "Comic Neue", "Cousine", "DM Serif Display", "EB Garamond", "Inter", "Lato", "Lexend", "Libre Baskerville",
    "Libre Franklin", "Merriweather", "Montserrat", "Noto Sans", "Noto Serif", "NTR", "Open Sans", "Patrick Hand", "Poppins", "Roboto", "Roboto Mono", "Roboto Slab", "Schoolbell", "Tinos",
)
# Family, what replaces it, confidence, whether a person must look.
SUBSTITUTES = (
    ("aptos", "Carlito", "medium", False),
    ("aptos display", "Carlito", "medium", False),
    ("aptos narrow", "Roboto", "low", True),
    ("segoe ui", "Inter", "medium", False),
    ("baskerville", "Libre Baskerville", "high", False),
    ("rockwell", "Roboto Slab", "medium", False),
    ("bradley hand itc", "Patrick Hand", "medium", False),
    ("segoe print", "Patrick Hand", "medium", False),
    ("lucida handwriting", "Caveat", "medium", False),
    ("chalkboard", "Schoolbell", "medium", False),
    ("chalkboard se", "Schoolbell", "medium", False),
    ("chalkduster", "Schoolbell", "medium", False),
    ("sassoon primary", "Andika", "medium", False),
    ("sassoon infant", "Andika", "medium", False),
    ("sassoonprimaryinfant", "Andika", "medium", False),
    ("sassoonprimarytype", "Andika", "medium", False),
    ("sassoon primary infant", "Andika", "medium", False),
    ("sassoon primary type", "Andika", "medium", False),
    ("sassooninfant", "Andika", "medium", False),
    ("twinkl", "Andika", "low", True),
    ("opendyslexic", "Lexend", "low", True),
    ("dyslexie", "Lexend", "low", True),
)


def dimension(spark: SparkSession) -> DataFrame:
    """(key, rank, status, replacement, confidence, manual_review): every known family under its key; 73 rows."""
    made = [(n, 0, "AVAILABLE", None, "high", False) for n in NATIVE] + [(n, 1, "AVAILABLE", n, "high", False) for n in CURATED] + [(n, 2, "SUBSTITUTED", r, c, m) for n, r, c, m in SUBSTITUTES]
    rows = spark.createDataFrame(made, "name string, rank int, status string, replacement string, confidence string, manual_review boolean")
    return rows.withColumn("key", family_key(F.col("name")))


def compatibility(families: DataFrame, name: str = "family") -> DataFrame:
    """(key, family, status, replacement, confidence, manual_review): one row for each distinct family, by key.

    Native before curated before substituted, else UNKNOWN for a person to look at. A comma-separated list is judged by
    its first item: unknown stays unknown, substituted stays so, available becomes a substitution by that item. Of
    several spellings the smallest is kept. Blank names are left out.
    """
    known = dimension(families.sparkSession)
    key = family_key(F.col(name))
    own = families.where(F.trim(name) != "").groupBy(key.alias("key")).agg(F.min(F.trim(F.regexp_replace(name, r"\s+", " "))).alias("family"))
    own = own.withColumn("judged", F.when(F.contains("family", F.lit(",")), family_key(list_head(F.col("family")))).otherwise(F.col("key")))
    first = known.groupBy(F.col("key").alias("judged")).agg(F.min_by(F.struct("name", "status", "replacement", "confidence", "manual_review"), "rank").alias("k"))
    out = own.join(F.broadcast(first), "judged", "left")
    by_list = F.col("judged") != F.col("key")
    status = F.coalesce("k.status", F.lit("UNKNOWN"))
    passed = by_list & (status == "AVAILABLE")
    return out.select(
        "key",
        "family",
        F.when(passed, "SUBSTITUTED").otherwise(status).alias("status"),
        F.when(passed, F.coalesce("k.replacement", "k.name")).otherwise(F.col("k.replacement")).alias("replacement"),
        F.when(passed, "high").otherwise(F.col("k.confidence")).alias("confidence"),
        F.coalesce("k.manual_review", F.lit(True)).alias("manual_review"),
    )


def is_symbol(charset: Column, panose: Column) -> Column:
    """Whether a font draws symbols rather than letters."""
    return F.coalesce((charset == "02") | F.startswith(panose, F.lit("05")), F.lit(False))


def applied(catalogue: DataFrame, embedded: Column, symbol: Column, confidences: tuple[str, ...] = ("high",)) -> DataFrame:
    """Substitutions that are made without asking."""
    return catalogue.where((F.col("status") == "SUBSTITUTED") & F.col("confidence").isin(*confidences) & ~F.col("manual_review") & ~embedded & ~symbol)


def substitution_counts(uses: DataFrame, chosen: DataFrame, name: str = "family") -> DataFrame:
    """(key, replacement, n): how often each substitution is made."""
    return uses.withColumn("key", family_key(F.col(name))).join(chosen.select("key", "replacement"), "key").groupBy("key", "replacement").agg(F.count(F.lit(1)).alias("n"))


def notes(catalogue: DataFrame) -> DataFrame:
    """(code, detail): one note for all substitutions together, one for each unknown family."""
    swapped = catalogue.where("status = 'SUBSTITUTED'").agg(F.array_sort(F.collect_set(F.concat_ws(" → ", "family", "replacement"))).alias("x"))
    some = swapped.where(F.size("x") > 0).select(F.lit("fonts_substituted").alias("code"), F.concat_ws(", ", "x").alias("detail"))
    return some.unionByName(catalogue.where("status = 'UNKNOWN'").select(F.lit("font_unavailable").alias("code"), F.col("family").alias("detail")))
