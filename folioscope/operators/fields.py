"""Computed fields in document markup: which texts are only the cached results of fields.

Markers are flat and nest, so a text belongs to every field that is open around it. The depth is a running sum; a marker
and its end share the depth and are matched by order within it, which needs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields whose results are made anew.
REGENERATED = ("TOC", "TOA", "INDEX", "PAGE", "NUMPAGES", "SECTIONPAGES", "PAGEREF", "SEQ", "STYLEREF", "DATE", "TIME", "CREATEDATE", "SAVEDATE", "PRINTDATE", "REVNUM")


def field_name(instruction: Column) -> Column:
    return F.upper(F.split(F.trim(F.regexp_replace(F.trim(instruction), r"^\\+", "")), " ")[0])


def cached_texts(marks: DataFrame, part: str = "part", order: str = "ord") -> DataFrame:
    """(part, ord) of texts inside the result of a regenerated field.

    marks: part, ord, kind (begin, separate, end, instr, text) and text. A field's instruction is what its own depth
    holds before its separator. An end without a beginning is ignored; a field without an end runs to the part's.
    """
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    raw = marks.withColumn("__sum", F.sum(step).over(w))
    # Ends that find nothing open do not count: the depth is the sum over its lowest value so far.
    deep = raw.withColumn("__depth", F.col("__sum") - F.least(F.min("__sum").over(w), F.lit(0)))
    deep = deep.withColumn("__at", F.when(F.col("kind") == "end", F.col("__depth") + 1).otherwise(F.col("__depth")))
    begins = deep.where("kind = 'begin'")
    nth = Window.partitionBy(part, "__at").orderBy(order)
    starts = begins.select(part, "__at", F.col(order).alias("__from"), F.coalesce(F.lead(order).over(nth), F.lit(2**62)).alias("__next"))
    own = deep.where("kind in ('separate', 'instr', 'end')").join(starts, [part, "__at"]).where((F.col(order) > F.col("__from")) & (F.col(order) < F.col("__next")))
    fields = own.groupBy(part, "__at", "__from").agg(
        F.min(F.when(F.col("kind") == "separate", F.col(order))).alias("__result"),
        F.coalesce(F.min(F.when(F.col("kind") == "end", F.col(order))), F.lit(2**62)).alias("__end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "instr", F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))), lambda x: x["t"]), "").alias("__instruction"),
    )
    made = fields.where(field_name(F.col("__instruction")).isin(*REGENERATED) & F.col("__result").isNotNull())
    # Outermost results only, so that every text meets at most one.
    reach = F.max("__end").over(Window.partitionBy(part).orderBy("__result").rowsBetween(Window.unboundedPreceding, -1))
    outer = made.withColumn("__reach", reach).where("__reach is null or __result > __reach").select(part, F.col("__result").alias(order), F.col("__end").alias("__until"))
    points = marks.where("kind = 'text'").select(part, order, F.lit(None).cast("long").alias("__until")).unionByName(outer.select(part, order, F.col("__until").cast("long")))
    last = points.withColumn("__open", F.last("__until", ignorenulls=True).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    return last.where(F.col("__until").isNull() & (F.col(order) < F.col("__open"))).select(part, order)


def field_counts(marks: DataFrame, part: str = "part", order: str = "ord") -> DataFrame:
    """(part, fields, cached): fields begun, and texts that are only their results."""
    cached = cached_texts(marks, part, order).groupBy(part).agg(F.count(F.lit(1)).alias("cached"))
    begun = marks.groupBy(part).agg(F.count(F.when(F.col("kind") == "begin", 1)).alias("fields"))
    return begun.join(cached, part, "left").fillna(0, ["cached"])
