"""Set and multiset operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, each as often as it is short."""
    return a.exceptAll(b)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with the side they are on."""
    keys = a.columns
    left = a.distinct().join(b.distinct(), keys, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.distinct().join(a.distinct(), keys, "left_anti").withColumn("side", F.lit("right")))


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; a column that a table lacks is null there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)


def summed(*reports: DataFrame, key: str, value: str) -> DataFrame:
    """The sum of counters."""
    return stacked(*reports).groupBy(key).agg(F.sum(value).alias(value))
