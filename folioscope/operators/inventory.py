"""Counts, roll-ups and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens


def token_counts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, token, n): how often each word stands in each key's texts."""
    return df.select(*keys, F.explode(tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def missing_tokens(source: DataFrame, other: DataFrame, keys: Sequence[str], name: str = "missing_tokens") -> DataFrame:
    """(keys, missing): by key, how many words of the source the other lacks, each as often as it is short. Both from token_counts()."""
    both = source.join(other.withColumnRenamed("n", "__other"), [*keys, "token"], "left")
    return both.groupBy(*keys).agg(F.sum(F.greatest(F.col("n") - F.coalesce("__other", F.lit(0)), F.lit(0))).cast("long").alias(name))


def count_map(df: DataFrame, keys: Sequence[str], kind: str, name: str = "counts") -> DataFrame:
    """A map of kind to count for each key, in the order of the kinds."""
    n = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias(name))


def content_groups(df: DataFrame, content: str, member: str) -> DataFrame:
    """Distinct contents by SHA-256, with the first member, all members in order, and their number."""
    return df.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min(member).alias("first_member"), F.array_sort(F.collect_list(member)).alias("members"), F.count(F.lit(1)).alias("n_members"))


def first_mode(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column | str], name: str = "mode") -> DataFrame:
    """The most frequent value of each key; of equals the one that ``order``, over (value, n), puts first."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), *order)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, F.col(value).alias(name), "n")


def note_summary(notes: DataFrame, keys: Sequence[str], page: str, status: str, order: str) -> DataFrame:
    """(keys, count, pages, status): each distinct note with its pages, sorted and counted from 1, and its first line's status."""
    return notes.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set(F.col(page) + 1)).alias("pages"), F.min_by(status, order).alias("status"))


def usage(df: DataFrame, key: str, page: str, event: str) -> DataFrame:
    """Uses of each key, with its first event and the page of that."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("usage_count"), F.min_by(page, event).alias("first_page"), F.min(event).alias("first_event"))


def requirements(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Distinct keys with each flag true if it is anywhere."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])


def row_heights(cells: DataFrame, keys: Sequence[str], padding: float = 6.4, fill: float = 0.97) -> DataFrame:
    """Height of each table row: its tallest cell's content over ``fill`` with the padding on both sides, its minimum at least.

    cells: keys, row, col, span, row_span, covered, content, minimum. Covered cells and those over several rows don't count.
    """
    own = cells.where(~F.col("covered") & (F.col("row_span") == 1))
    tallest = own.groupBy(*keys, "row").agg(F.max(F.col("content") / fill + 2 * padding).alias("__h"))
    least = cells.groupBy(*keys, "row").agg(F.max("minimum").alias("__m"))
    return least.join(tallest, [*keys, "row"], "left").select(*keys, "row", F.greatest(F.col("__m"), F.coalesce("__h", "__m")).alias("height"))


def cell_widths(cells: DataFrame, columns: DataFrame, keys: Sequence[str], frame: Column) -> DataFrame:
    """Cells with the width of the columns they span, stretched so that all columns fill the frame."""
    w = Window.partitionBy(*keys)
    stretched = columns.withColumn("__w", F.col("width") * frame / F.sum("width").over(w)).select(*keys, F.col("col").alias("__col"), "__w")
    spread = cells.withColumn("__col", F.explode(F.sequence("col", F.col("col") + F.col("span") - 1)))
    own = spread.join(stretched, [*keys, "__col"]).groupBy(*keys, "row", "col").agg(F.sum("__w").alias("cell_width"))
    return cells.join(own, [*keys, "row", "col"], "left")
