"""Queries that depend on an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ordered
from .registry import micros, query, table

_HOUR = 3_600_000_000


@query("""
SELECT event_id, user_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase FROM events
""")
def q12_forward_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase that each event leads up to."""
    out = ordered.forward_owner(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "next_purchase")
    return out.select("event_id", "user_id", "next_purchase")


@query(f"""
SELECT user_id, band, count(*) AS n, min(event_id) AS first_event FROM (
    SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM (
        SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN lag(epoch_us(ts)) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > {6 * _HOUR} THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
GROUP BY user_id, band
""")
def q13_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user with no gap over six hours."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("at"))
    out = ordered.bands(events, ["user_id"], ["at", "event_id"], F.col("at"), 6 * _HOUR)
    return out.groupBy("user_id", "band").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS n,
    CASE WHEN row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1 THEN p_name ELSE p_name || ' (' || CAST(row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS VARCHAR) || ')' END AS unique_label FROM part
""")
def q15_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts numbered by kind, and names made unique."""
    parts = ordered.numbered(table(spark, sf_dir, "part"), ["p_type"], ["p_size", "p_partkey"])
    return ordered.unique_labels(parts, "p_name", ["p_partkey"]).select("p_partkey", "p_type", F.col("n").cast("long").alias("n"), "unique_label")


@query("""
SELECT conv_id, island, role, count(*) AS n, min(turn) AS first_turn FROM (
    SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
        SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM conversations)) GROUP BY conv_id, island, role
""")
def q16_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns by one role."""
    out = ordered.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    return out.groupBy("conv_id", "island", "role").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


_UTF16 = r"(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"


@query(f"""
SELECT conv_id, turn, CAST(coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n AS BIGINT) AS "end"
FROM (SELECT conv_id, turn, {_UTF16} AS n FROM conversations)
""")
def q17_running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns end to end in UTF-16 units, one apart."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.utf16_length(F.col("text")).alias("n"))
    return ordered.running_spans(turns, ["conv_id"], ["turn"], F.col("n"), 1).select("conv_id", "turn", "start", "end")


@query("""
SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, lag(role) OVER w AS a, lead(role) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE a = b AND a <> role
""")
def q18_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns between two turns of one other role."""
    out = ordered.between_equals(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    return out.where("between").select("conv_id", "turn", "role")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, expected FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS expected FROM lineitem) WHERE expected <> l_linenumber")
def q19_dense_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose number isn't their place, from 0, in their order."""
    out = ordered.out_of_place(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("expected").cast("long").alias("expected"))


@query("""
WITH bought AS (SELECT DISTINCT p_brand, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT p_brand, count(*) AS n_members FROM bought GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT m) FROM bought) AND count(*) >= 2
""")
def q20_on_every_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands ordered in every month that has orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "m").distinct()
    return ordered.in_all(bought, ["p_brand"], "m")


@query("""
SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later,
    max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS before FROM conversations) WHERE later = 1 AND before = 1
""")
def q61_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without those before the first and behind the last of a user."""
    other = F.col("role") != "user"
    turns = ordered.without_trailing(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], other)
    return ordered.without_leading(turns, ["conv_id"], ["turn"], other).select("conv_id", "turn")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, r AS rank, greatest(n - 3, 0) AS n_more FROM (
    SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE r <= 3
""")
def q49_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest lines of each supplier, and how many more there are."""
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
    out = ordered.top_of(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank").cast("long").alias("rank"), "n_more")


@query("""
SELECT e.event_id, e.user_id, e.event_type, (SELECT p.event_type FROM events p WHERE p.user_id = e.user_id AND (p.ts, p.event_id) < (e.ts, e.event_id) ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) AS before
FROM events e WHERE e.event_type = 'purchase'
""")
def q62_previous_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the user did right before each purchase."""
    events = table(spark, sf_dir, "events")
    w = ordered.ordered(["user_id"], ["ts", "event_id"])
    return events.withColumn("before", F.lag("event_type").over(w)).where("event_type = 'purchase'").select("event_id", "user_id", "event_type", "before")
