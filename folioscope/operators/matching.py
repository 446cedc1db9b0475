"""Joins: with miss flags, by place, by rectangle, by tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measure import contains


def with_miss(left: DataFrame, right: DataFrame, on: Column, hit: str, name: str = "missing") -> DataFrame:
    """Left outer join, and whether the right side is missing; ``hit`` is a right column that is never null."""
    return left.join(right, on, "left").withColumn(name, F.col(hit).isNull())


def collected_uses(targets: DataFrame, uses: DataFrame, key: str, use: Sequence[str], name: str = "uses") -> DataFrame:
    """Every target with the sorted list of its uses, empty where it has none."""
    held = uses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*use))).alias(name))
    kind = held.schema[name].dataType
    return targets.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def violations(left: DataFrame, right: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Left keys without a right row, as problems."""
    gone = left.join(right.select(*keys).distinct(), list(keys), "left_anti").select(*keys).distinct()
    return gone.select(F.lit(code).alias("code"), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("subject"))


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], equal_counts: bool = False, rank: str = "k") -> DataFrame:
    """k-th left row with k-th right row of each key. Surplus is left out; with ``equal_counts`` so is a key whose sides differ in number."""

    def ranked(df: DataFrame, order: Sequence[str], side: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.withColumn(rank, F.row_number().over(w.orderBy(*order))).withColumn(f"__n_{side}", F.count(F.lit(1)).over(w))

    both = ranked(left, left_order, "l").join(ranked(right, right_order, "r"), [*keys, rank])
    return (both.where("__n_l = __n_r") if equal_counts else both).drop("__n_l", "__n_r")


def contained(panels: DataFrame, hosts: DataFrame, keys: Sequence[str], panel_box: str, host_box: str, panel_id: str, host_id: str, slack: float = 0) -> DataFrame:
    """Each panel with the first host, by id, of its key that contains it; a box with the panel's own id is no host of it."""
    both = panels.join(hosts, list(keys)).where((F.col(panel_id) != F.col(host_id)) & contains(F.col(host_box), F.col(panel_box), slack))
    w = Window.partitionBy(*keys, panel_id).orderBy(host_id)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def binned_pairs(df: DataFrame, keys: Sequence[str], value: str, ident: str, tolerance: float) -> DataFrame:
    """(keys, a, b, gap): pairs a < b of rows of a key whose values are at most ``tolerance`` apart.

    Each row meets its own bin and the next, so the work follows the pairs that are near, not the square of the key.
    """
    bin_ = F.floor(F.col(value) / tolerance)
    base = df.select(*keys, F.col(ident).alias("a"), F.col(value).alias("va"), bin_.alias("bin"))
    other = df.select(*keys, F.col(ident).alias("b"), F.col(value).alias("vb"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"))
    both = base.join(other, [*keys, "bin"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= tolerance))
    return both.select(*keys, "a", "b", F.abs(F.col("va") - F.col("vb")).alias("gap"))


def nearest(df: DataFrame, keys: Sequence[str], value: str, ident: str) -> DataFrame:
    """(keys, ident, near, gap): the row of the key with the nearest value, of equals the one with the smaller id; by neighbours in order, without pairs."""
    up = Window.partitionBy(*keys).orderBy(value, F.col(ident).desc())
    down = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(ident).desc())
    held = F.struct(F.col(value).alias("v"), F.col(ident).alias("i"))
    # Of rows with one value the smallest id is the best candidate for rows on either side; among themselves the next smallest.
    same = Window.partitionBy(*keys, value).orderBy(ident)
    out = df.withColumn("__below", F.lag(held).over(up)).withColumn("__above", F.lag(held).over(down))
    out = out.withColumn("__first", F.first(ident).over(same)).withColumn("__second", F.nth_value(ident, 2).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    twin = F.when(F.col(ident) == F.col("__first"), F.col("__second")).otherwise(F.col("__first"))
    candidates = F.array(
        F.when(twin.isNotNull(), F.struct(F.lit(0.0).alias("gap"), twin.alias("near"))),
        F.when(F.col("__below").isNotNull(), F.struct(F.abs(F.col(value) - F.col("__below.v")).alias("gap"), F.col("__below.i").alias("near"))),
        F.when(F.col("__above").isNotNull(), F.struct(F.abs(F.col(value) - F.col("__above.v")).alias("gap"), F.col("__above.i").alias("near"))),
    )
    best = F.array_min(F.filter(candidates, lambda c: c.isNotNull()))
    return out.select(*keys, ident, best["near"].alias("near"), best["gap"].alias("gap"))


def sole_candidate(wanted: DataFrame, found: DataFrame, keys: Sequence[str], wanted_id: str, size: str, found_size: str, found_id: str, slack: float) -> DataFrame:
    """Each wanted row with the found row whose size is within ``slack``, where exactly one is."""
    both = wanted.join(found, list(keys)).where(F.abs(F.col(size) - F.col(found_size)) <= slack)
    return both.groupBy(*keys, wanted_id).agg(F.count(F.lit(1)).alias("__n"), F.min(found_id).alias(found_id)).where("__n = 1").drop("__n")


def interval_join(left: DataFrame, right: DataFrame, start: str, end: str, at: str, bin_size: int) -> DataFrame:
    """Left intervals [start, end] with the right rows whose ``at`` lies inside. Both in whole units; by bins of ``bin_size``."""
    spread = left.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    point = right.withColumn("__bin", F.floor(F.col(at) / bin_size))
    return spread.join(point, "__bin").where(F.col(at).between(F.col(start), F.col(end))).drop("__bin")
