"""Queries over event time: windows, as-of state, state machines, and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evaluate import evaluated
from ..operators import ordered, timeline
from ..streaming import jobs
from .registry import micros, query, table

_HOUR = 3_600_000_000
_DAY = 24 * _HOUR


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))


@query("""
SELECT event_id, user_id, (SELECT o.event_type FROM events o WHERE o.user_id = p.user_id AND o.event_type <> 'purchase' AND o.ts <= p.ts ORDER BY o.ts DESC, o.event_type DESC LIMIT 1) AS as_of_event_type
FROM events p WHERE event_type = 'purchase'
""")
def q32_as_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last other event of the user at each purchase."""
    events = _events(spark, sf_dir)
    out = ordered.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "at"), events.where("event_type <> 'purchase'"), ["user_id"], "at", ["event_type"])
    return out.select("event_id", "user_id", "as_of_event_type")


@query(f"SELECT event_type, epoch_us(ts) // {_DAY} * {_DAY} AS window_start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def q33_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.tumbling(_events(spark, sf_dir), F.col("at"), _DAY, ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")])


@query(f"""
SELECT event_type, window_start, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(ts) // {6 * _HOUR} * {6 * _HOUR} - k * {6 * _HOUR} for k in [0, 1, 2, 3]]) AS window_start FROM events) GROUP BY ALL
""")
def q34_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sliding(_events(spark, sf_dir), F.col("at"), _DAY, 6 * _HOUR, ["event_type"], [F.count(F.lit(1)).alias("n")])


@query(f"""
SELECT user_id, min(us) AS session_start, max(us) + {2 * _HOUR} AS session_end, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN lag(epoch_us(ts)) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w >= {2 * _HOUR} THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
GROUP BY user_id, s
""")
def q35_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sessions(_events(spark, sf_dir), ["user_id"], "at", 2 * _HOUR, ["event_id"])


@query(f"""
SELECT window_start, count(*) AS n, count(*) FILTER (WHERE us < seen - {_DAY // 2}) AS n_late FROM (
    SELECT epoch_us(ts) // {_DAY} * {_DAY} AS window_start, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events) GROUP BY 1
""")
def q36_late_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, and how many a watermark of half a day, by user, would have dropped."""
    from pyspark.sql.window import Window

    seen = F.max("at").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return timeline.tumbling(_events(spark, sf_dir).withColumn("seen", seen), F.col("at"), _DAY, [], [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("at") < F.col("seen") - _DAY // 2, 1)).alias("n_late")])


_STEPS = {("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("new", "signup")}


@query("""
SELECT event_id, user_id, event_type, state_before FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'new') AS state_before FROM events)
WHERE state_before || '>' || event_type NOT IN ('signup>view', 'view>click', 'view>view', 'click>purchase', 'click>view', 'purchase>view', 'new>signup')
""")
def q66_illegal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between a user's events that a transition table does not allow."""
    out = timeline.illegal_steps(_events(spark, sf_dir), ["user_id"], ["at", "event_id"], "event_type", _STEPS, "new")
    return out.select("event_id", "user_id", "event_type", "state_before")


@query()
def q54_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final job state of each user, whose events ask for transitions; those that aren't legal are counted and ignored."""
    return jobs.final_states(jobs.requests_of_events(_events(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, 0.5 * l_quantity / (2 - l_discount) AS value FROM lineitem")
def q55_eval_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An animation formula over each line's numbers."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    formula = F.concat(F.lit("#ppt_w*"), F.col("l_quantity").cast("string"), F.lit("/(2-"), F.col("l_discount").cast("string"), F.lit(")"))
    return line.select("l_orderkey", "l_linenumber", evaluated(formula, F.lit(0.5), F.lit(0.25)).alias("value"))


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS "index", row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 25 AS kept FROM events
""")
def q67_event_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted on past a budget of 25 a user, kept within it."""
    out = timeline.within_budget(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 25)
    return out.select("user_id", "event_id", F.col("index").cast("long").alias("index"), "kept")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber % 3 AS grp, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS delay, CAST(l_tax * 100 AS BIGINT) AS duration FROM lineitem),
g AS (SELECT l_orderkey, grp, greatest(max(delay + duration), 0) AS long FROM e GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(long) OVER (PARTITION BY l_orderkey ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g)
SELECT e.l_orderkey, e.l_linenumber, e.l_partkey, e.l_suppkey, CAST(base + delay AS BIGINT) AS start, CAST(base + delay + duration AS BIGINT) AS "end" FROM e JOIN b ON e.l_orderkey = b.l_orderkey AND e.grp = b.grp
""")
def q68_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as effects of click groups, on one clock."""
    effects = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("group"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("delay"), F.round(F.col("l_tax") * 100).cast("long").alias("duration"))
    return timeline.flattened(effects, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start", "end")
