"""Timelines: click groups, state at a time, windows over events, state machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flattened(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Effects (keys, group, ord, delay, duration) with start and end on one clock.

    A click group starts where everything before it has ended; inside it an effect starts at its delay.
    """
    spans = effects.groupBy(*keys, "group").agg(F.max(F.greatest(F.col("delay") + F.col("duration"), F.lit(0))).alias("__long"))
    before = Window.partitionBy(*keys).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("__base", F.coalesce(F.sum("__long").over(before), F.lit(0)))
    out = effects.join(starts.drop("__long"), [*keys, "group"])
    return out.withColumn("start", F.col("__base") + F.col("delay")).withColumn("end", F.col("start") + F.col("duration")).drop("__base")


def state_at(effects: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Visibility, opacity, offset and scale of each key at a time, from effects (kind, start, end, hold, value).

    kind: show, hide (the last at or before the time decides; hidden at first if there is a show at all), opacity and
    scale (multiply), motion (adds). Effects other than show and hide are over once they end, unless they hold.
    """
    toggles = F.col("kind").isin("show", "hide")
    due = F.col("start") <= at
    live = due & (F.coalesce("hold", F.lit(False)) | (F.col("end") > at))
    product = lambda kind: F.coalesce(F.product(F.when(live & (F.col("kind") == kind), F.col("value"))), F.lit(1.0)).alias(kind)
    last = F.max_by(F.when(toggles & due, F.col("kind")), F.when(toggles & due, F.struct("start", "ord")))
    return effects.groupBy(*keys).agg(
        F.coalesce(last == "show", ~F.coalesce(F.bool_or(F.col("kind") == "show"), F.lit(False))).alias("visible"),
        product("opacity"),
        product("scale"),
        F.coalesce(F.sum(F.when(live & (F.col("kind") == "motion"), F.col("value"))), F.lit(0.0)).alias("motion"),
    )


def tumbling(df: DataFrame, at: Column, size: int, keys: Sequence[Column | str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by windows of ``size`` of a whole-number clock, named by their start."""
    return df.groupBy(*keys, (F.floor(at / size) * size).cast("long").alias("window_start")).agg(*aggregates)


def sliding(df: DataFrame, at: Column, size: int, step: int, keys: Sequence[Column | str], aggregates: Sequence[Column]) -> DataFrame:
    """As tumbling(), with a window at every ``step``; ``size`` is a multiple of it."""
    last = F.floor(at / step) * step
    starts = F.transform(F.sequence(F.lit(0), F.lit(size // step - 1)), lambda k: (last - k * step).cast("long"))
    return df.withColumn("window_start", F.explode(starts)).groupBy(*keys, "window_start").agg(*aggregates)


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap: int, order: Sequence[str]) -> DataFrame:
    """(keys, session_start, session_end, n): runs of rows less than ``gap`` apart; the end is a gap behind the last."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    new = F.when(F.lag(at).over(w).isNull() | (F.col(at) - F.lag(at).over(w) >= gap), 1).otherwise(0)
    numbered = df.withColumn("__new", new).withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__s").agg(F.min(at).alias("session_start"), (F.max(at) + gap).alias("session_end"), F.count(F.lit(1)).alias("n")).drop("__s")


#: Allowed steps of a job: from, to.
TRANSITIONS = {("pending", "running"), ("ready", "running"), ("retryable", "running"), ("running", "retryable"), ("failed", "retryable"), ("running", "done"), ("running", "failed")}


def illegal_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, allowed: set[tuple[str, str]], initial: str) -> DataFrame:
    """Rows whose step from the state before them, or from ``initial``, isn't allowed."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(initial))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(allowed)])
    return df.withColumn("state_before", before).where(~F.array_contains(pairs, F.struct(F.col("state_before").alias("a"), F.col(state).alias("b"))))


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Rows with their index in the key, and whether they are kept: counting goes on past the budget, keeping doesn't."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("index", F.row_number().over(w) - 1).withColumn("kept", F.col("index") < most)
