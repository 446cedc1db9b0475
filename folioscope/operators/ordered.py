"""Operators that depend on an order. Each takes a key to partition by, so that no order runs over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut

Cols = Sequence[str | Column]


def ordered(keys: Cols, order: Cols):
    return Window.partitionBy(*keys).orderBy(*order)


def forward_owner(df: DataFrame, keys: Cols, order: Cols, marks: Column, value: Column, name: str) -> DataFrame:
    """The value of the first marked row at or after each row of its key; null behind the last."""
    ahead = ordered(keys, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(marks, value), ignorenulls=True).over(ahead))


def carried(df: DataFrame, keys: Cols, order: Cols, marks: Column, value: Column, name: str) -> DataFrame:
    """The value of the last marked row at or before each row of its key."""
    behind = ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(F.when(marks, value), ignorenulls=True).over(behind))


def bands(df: DataFrame, keys: Cols, order: Cols, value: Column, gap: float, name: str = "band") -> DataFrame:
    """Number, from 1, of the band each row is in: a band ends where the step from its last member exceeds ``gap``."""
    w = ordered(keys, order)
    new = F.when(F.lag(value).over(w).isNull() | (value - F.lag(value).over(w) > gap), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def first_of(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(ordered(keys, order))).where("__n = 1").drop("__n")


def numbered(df: DataFrame, keys: Cols, order: Cols, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(ordered(keys, order)))


def unique_labels(df: DataFrame, label: str, order: Cols, name: str = "unique_label") -> DataFrame:
    """The label, with `` (k)`` from the second of a folded label on."""
    from ..functions.text import folded

    k = F.row_number().over(Window.partitionBy(folded(F.col(label))).orderBy(*order))
    return df.withColumn(name, F.when(k == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" ("), k.cast("string"), F.lit(")"))))


def islands(df: DataFrame, keys: Cols, order: Cols, value: Column, name: str = "island") -> DataFrame:
    """Number, from 1, of the run of equal values that each row is in; null is a value, and breaks runs like any other."""
    w = ordered(keys, order)
    new = F.when(F.row_number().over(w) == 1, 1).when(~value.eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_spans(df: DataFrame, keys: Cols, order: Cols, length: Column, gap: int = 0) -> DataFrame:
    """start and end of each row's length when the rows of a key stand end to end, ``gap`` apart."""
    before = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length + gap).over(before), F.lit(0)).cast("long")
    return df.withColumn("start", start).withColumn("end", (F.col("start") + length).cast("long"))


def between_equals(df: DataFrame, keys: Cols, order: Cols, value: Column, name: str = "between") -> DataFrame:
    """Whether a row stands between two rows of one and the same other value."""
    w = ordered(keys, order)
    return df.withColumn(name, F.coalesce((F.lag(value).over(w) == F.lead(value).over(w)) & (F.lag(value).over(w) != value), F.lit(False)))


def out_of_place(df: DataFrame, keys: Cols, order: Cols, index: str, name: str = "expected") -> DataFrame:
    """Rows whose index isn't their place, from 0, in their key."""
    return df.withColumn(name, F.row_number().over(ordered(keys, order)) - 1).where(F.col(name) != F.col(index))


def in_all(df: DataFrame, group: Cols, member: str, least: int = 2) -> DataFrame:
    """Groups that have a row for every distinct ``member`` of the table, if there are ``least`` at all."""
    total = df.agg(F.countDistinct(member).alias("__all"))
    held = df.groupBy(*group).agg(F.countDistinct(member).alias("n_members"))
    return held.crossJoin(F.broadcast(total)).where((F.col("n_members") == F.col("__all")) & (F.col("__all") >= least)).drop("__all")


def without_trailing(df: DataFrame, keys: Cols, order: Cols, empty: Column) -> DataFrame:
    """Without the rows behind the last one that isn't empty."""
    ahead = ordered(keys, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn("__any", F.max((~empty).cast("int")).over(ahead)).where("__any = 1").drop("__any")


def without_leading(df: DataFrame, keys: Cols, order: Cols, empty: Column) -> DataFrame:
    """Without the rows before the first one that isn't empty."""
    behind = ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__any", F.max((~empty).cast("int")).over(behind)).where("__any = 1").drop("__any")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it (strict: before it).

    One sort over both tables; no row is paired with more than one. Of right rows at one time the last by value counts.
    """
    side = F.lit(2 if strict else 0)
    held = F.struct(*[F.col(f"`{v}`") for v in values])
    a = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(at).alias("__at"), F.lit(1).alias("__side"))
    b = right.select(held.alias("__held"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(at).alias("__at"), side.alias("__side"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__at", "__side", "__held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__held", ignorenulls=True).over(w)).where("__row is not null")
    return out.select("__row.*", *[F.col("__last")[v].alias(f"as_of_{v}") for v in values])


def positions(df: DataFrame, order: Cols, name: str = "position") -> DataFrame:
    """Place of each row, from 0, in an order over the whole table: ranges in parallel, and a sum over their sizes.

    The order must be total, or equal rows get their places by chance.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = ranged.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return own.join(F.broadcast(before), "__part").withColumn(name, F.col("__first") + F.col("__own") - 1).drop("__part", "__first", "__own")


def top_of(df: DataFrame, keys: Cols, order: Cols, most: int) -> DataFrame:
    """The first ``most`` rows of each key with their rank, and how many rows of the key are left out."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("n_more", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)))
    return ranked.where(F.col("rank") <= most)
