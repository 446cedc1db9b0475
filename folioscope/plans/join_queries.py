"""Queries over joins, trees and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure
from ..operators import graph, inventory, matching, ordered
from .registry import micros, query, table

_DAY = 86_400_000_000


@query("SELECT o_orderkey, o_custkey, c_mktsegment, c_custkey IS NULL AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def q21_fk_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer in credit, and whether there is none."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    out = matching.with_miss(table(spark, sf_dir, "orders"), customers, F.col("o_custkey") == F.col("c_custkey"), "c_custkey")
    return out.select("o_orderkey", "o_custkey", "c_mktsegment", "missing")


@query("SELECT c_custkey, CAST(len(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL)) AS BIGINT) AS n_uses, array_to_string(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), ',') AS uses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q22_inverse_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its orders."""
    uses = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = matching.collected_uses(table(spark, sf_dir, "customer").select("c_custkey"), uses, "c_custkey", ["o_orderkey"])
    n = F.size("uses").cast("long")
    return out.select("c_custkey", F.when(n > 0, n).alias("n_uses"), F.when(n > 0, F.concat_ws(",", F.transform("uses", lambda u: u["o_orderkey"].cast("string")))).alias("uses"))


@query("""
SELECT 'customer_without_orders' AS code, CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'document_without_label', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def q23_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that point nowhere, as problems."""
    a = matching.violations(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"], "customer_without_orders")
    return a.unionByName(matching.violations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], "document_without_label"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q24_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select("doc_id", "lang")


@query(f"""
WITH signups AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'signup'),
errors AS (SELECT event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'error')
SELECT s.event_id AS signup, e.event_id AS error FROM signups s JOIN errors e ON e.at BETWEEN s.at AND s.at + {_DAY // 24}
""")
def q25_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within an hour after a signup, by bins of an hour."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", micros(F.col("ts")).alias("at"))
    signups = events.where("event_type = 'signup'").select(F.col("event_id").alias("signup"), F.col("at").alias("start"), (F.col("at") + _DAY // 24).alias("end"))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error"), "at")
    return matching.interval_join(signups, errors, "start", "end", "at", _DAY // 24).select("signup", "error")


@query("""
SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 2) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 500
""")
def q26_tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation whose balances are near."""
    out = matching.binned_pairs(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey", 500.0)
    return out.select("s_nationkey", "a", "b", F.round("gap", 2).alias("gap"))


@query("""
SELECT s_nationkey, s_suppkey, near, gap FROM (
    SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS near, round(abs(a.s_acctbal - b.s_acctbal), 2) AS gap, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS r
    FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) WHERE r = 1
""")
def q63_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of the nation with the nearest balance, by neighbours in order."""
    out = matching.nearest(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey")
    return out.where("near is not null").select("s_nationkey", "s_suppkey", "near", F.round("gap", 2).alias("gap"))


@query("""
WITH boxes AS (SELECT l_orderkey AS page, l_linenumber AS id, l_partkey, l_suppkey, l_quantity AS x, l_discount * 100 AS y, 1 + l_tax * 100 AS w, 1 + l_linenumber AS h FROM lineitem),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id, l_partkey, l_suppkey, x, y) AS n FROM boxes)
SELECT page, panel, host FROM (
    SELECT p.page, p.n AS panel, h.n AS host, row_number() OVER (PARTITION BY p.page, p.n ORDER BY h.n) AS r FROM numbered p JOIN numbered h ON p.page = h.page AND p.n <> h.n
        AND p.x >= h.x - 2 AND p.y >= h.y - 2 AND p.x + p.w <= h.x + h.w + 2 AND p.y + p.h <= h.y + h.h + 2) WHERE r = 1
""")
def q27_rect_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first box of an order that contains each other, within two units."""
    line = table(spark, sf_dir, "lineitem")
    box = measure.box(F.col("l_quantity"), F.col("l_discount") * 100, 1 + F.col("l_tax") * 100, (1 + F.col("l_linenumber")).cast("double"))
    boxes = ordered.numbered(line, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]).select(F.col("l_orderkey").alias("page"), F.col("n").cast("long").alias("n"), box.alias("box"))
    panels = boxes.select("page", F.col("n").alias("panel"), F.col("box").alias("panel_box"))
    hosts = boxes.select("page", F.col("n").alias("host"), F.col("box").alias("host_box"))
    return matching.contained(panels, hosts, ["page"], "panel_box", "host_box", "panel", "host", 2).select("page", "panel", "host")


@query("""
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations)
SELECT u.conv_id, u.k, u.turn AS user_turn, a.turn AS assistant_turn FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.k = a.k AND u.n = a.n WHERE u.role = 'user' AND a.role = 'assistant'
""")
def q28_rank_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-th user turn with k-th assistant turn, where there are as many."""
    of = lambda role: table(spark, sf_dir, "conversations").where(F.col("role") == role).select("conv_id", F.col("turn").alias(f"{role}_turn"))
    out = matching.zipped(of("user"), of("assistant"), ["conv_id"], ["user_turn"], ["assistant_turn"], equal_counts=True)
    return out.select("conv_id", F.col("k").cast("long").alias("k"), "user_turn", "assistant_turn")


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (7 * n_nationkey + 3) % 25 AS b FROM nation WHERE n_nationkey % 4 <> 0),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT CAST(a AS BIGINT) AS node FROM c WHERE a = b
""")
def q29_closure_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a small graph that reach themselves."""
    n = F.col("n_nationkey").cast("long")
    edges = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(n.alias("a"), ((7 * n + 3) % 25).alias("b"))
    return graph.cyclic_nodes(edges)


@query("""
SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 5000 THEN s_name END, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, r_name) AS label, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, CAST(n_regionkey AS DOUBLE)) AS weight
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def q30_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of suppliers, from themselves, their nation or their region: whichever states them first."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    no, text = F.lit(None), "string"
    nodes = (
        s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast(text)).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast(text)).alias("parent"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("label"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("weight"))
        .unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast(text)).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast(text)).alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("label"), F.col("n_regionkey").cast("double").alias("weight")))
        .unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast(text)).alias("id"), no.cast(text).alias("parent"), F.col("r_name").alias("label"), no.cast("double").alias("weight")))
    )
    out = graph.inherited(nodes, ["label", "weight"])
    return out.where("id like 's%'").select(F.substring("id", 2, 20).cast("long").alias("s_suppkey"), "label", "weight")


@query("""
WITH RECURSIVE e AS (SELECT doc_id // 10 AS a, doc_id AS b FROM documents WHERE doc_id > 0),
c AS (SELECT a, b, 1 AS hops FROM e UNION ALL SELECT c.a, e.b, hops + 1 FROM c JOIN e ON c.b = e.a)
SELECT a AS ancestor, count(*) AS n_descendants, max(hops) AS depth FROM c GROUP BY a
""")
def q31_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each node of a tree in which a document's parent is a tenth of its id."""
    edges = table(spark, sf_dir, "documents").where("doc_id > 0").select(F.floor(F.col("doc_id") / 10).alias("a"), F.col("doc_id").alias("b"))
    return graph.closure(edges).groupBy(F.col("a").alias("ancestor")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("hops").alias("depth"))


@query("""
SELECT l_suppkey, l_partkey AS wanted, min(near) AS near FROM (
    SELECT a.l_suppkey, a.l_partkey, b.l_partkey AS near FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) a
    JOIN (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) b ON a.l_suppkey = b.l_suppkey AND abs(a.q - b.q) <= 0.5) GROUP BY 1, 2 HAVING count(*) = 1
""")
def q64_sole_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a supplier whose finished quantity fits exactly one open one."""
    of = lambda s: table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    wanted = of("F").select("l_suppkey", F.col("l_partkey").alias("wanted"), F.col("q").alias("size"))
    found = of("O").select("l_suppkey", F.col("l_partkey").alias("near"), F.col("q").alias("found_size"))
    return matching.sole_candidate(wanted, found, ["l_suppkey"], "wanted", "size", "found_size", "near", 0.5)


@query("""
WITH cells AS (SELECT l_orderkey AS page, l_linenumber AS r, l_quantity AS content, l_partkey, l_discount > 0.05 AS covered FROM lineitem)
SELECT page, r AS "row", greatest(12.0, coalesce(max(content / 0.97 + 12.8) FILTER (WHERE NOT covered), 12.0)) AS height FROM cells GROUP BY page, r
""")
def q65_row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of rows by their tallest uncovered cell."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row"), F.col("l_quantity").alias("content"), (F.col("l_discount") > 0.05).alias("covered"), F.lit(1).alias("row_span"), F.lit(12.0).alias("minimum"))
    return inventory.row_heights(cells, ["page"])
