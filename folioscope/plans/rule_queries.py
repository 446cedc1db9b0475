"""Queries over rules, tiers, catalogues and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, sets
from .registry import query, table


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _rules() -> list[rules.Rule]:
    n = F.col("n_chars")
    return [
        ("cell_limit", "error", n > 8000),
        ("large_extent", "warning", (n > 4000) & (n <= 8000)),
        ("toxic", "error", F.coalesce(F.col("toxic") == 1, F.lit(False))),
        ("low_quality", "warning", F.coalesce(F.col("quality") == 0, F.lit(False))),
        ("unlabelled", "info", F.col("toxic").isNull()),
        ("short", "warning", n < 100),
    ]


_RULES_SQL = """
WITH facts AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
found AS (
    SELECT doc_id, 0 AS seq, 'cell_limit' AS code, 'error' AS level FROM facts WHERE n_chars > 8000
    UNION ALL SELECT doc_id, 1, 'large_extent', 'warning' FROM facts WHERE n_chars > 4000 AND n_chars <= 8000
    UNION ALL SELECT doc_id, 2, 'toxic', 'error' FROM facts WHERE toxic = 1
    UNION ALL SELECT doc_id, 3, 'low_quality', 'warning' FROM facts WHERE quality = 0
    UNION ALL SELECT doc_id, 4, 'unlabelled', 'info' FROM facts WHERE toxic IS NULL
    UNION ALL SELECT doc_id, 5, 'short', 'warning' FROM facts WHERE n_chars < 100)
"""


@query(_RULES_SQL + "SELECT doc_id, seq, code, level FROM found")
def q45_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a rule table, in its order."""
    return rules.findings(_facts(spark, sf_dir), ["doc_id"], _rules())


@query(_RULES_SQL + """
SELECT d.doc_id, CASE WHEN count(*) FILTER (WHERE code IN ('cell_limit', 'toxic')) > 0 THEN 'manual_migration_required' WHEN count(code) > 0 THEN 'converted_with_review' ELSE 'converted' END AS tier
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
""")
def q46_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).withColumn("codes", rules.codes(_rules()))
    return facts.select("doc_id", rules.tier(F.col("codes"), ["cell_limit", "toxic"]).alias("tier"))


@query("""
WITH native AS (SELECT DISTINCT lower(p_brand) AS key FROM part WHERE p_size > 45), curated AS (SELECT lower(p_brand) AS key, min(p_brand) AS canonical FROM part WHERE p_size BETWEEN 40 AND 45 GROUP BY 1),
subst AS (SELECT lower(p_brand) AS key, min(p_type) AS replacement FROM part WHERE p_retailprice > 1000 GROUP BY 1)
SELECT k.key, CASE WHEN n.key IS NOT NULL OR c.key IS NOT NULL THEN 'AVAILABLE' WHEN s.key IS NOT NULL THEN 'SUBSTITUTED' ELSE 'UNKNOWN' END AS status,
    CASE WHEN n.key IS NULL THEN coalesce(canonical, replacement) END AS replacement
FROM (SELECT DISTINCT lower(p_brand) AS key FROM part) k LEFT JOIN native n USING (key) LEFT JOIN curated c USING (key) LEFT JOIN subst s USING (key)
""")
def q47_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands looked up as native, curated, substituted, in that order."""
    part = table(spark, sf_dir, "part").withColumn("key", F.lower("p_brand"))
    native = part.where("p_size > 45").select("key").distinct()
    curated = part.where("p_size between 40 and 45").groupBy("key").agg(F.min("p_brand").alias("canonical"))
    subst = part.where("p_retailprice > 1000").groupBy("key").agg(F.min("p_type").alias("replacement"))
    return rules.catalogue(part, "key", native, curated, subst)


@query("""
SELECT event_id, user_id, event_type, made_at FROM (SELECT *, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS made_at FROM events)
WHERE event_type <> 'signup' AND (made_at IS NULL OR event_id < made_at)
""")
def q48_plan_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user before the first signup."""
    out = rules.used_before_made(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "signup")
    return out.select("event_id", "user_id", "event_type", "made_at")


@query("""
SELECT 'document' AS kind, doc_id AS subject, 'long' AS code, n_chars AS amount FROM documents WHERE n_chars > 8000
UNION ALL SELECT 'supplier', s_suppkey, 'in_debt', NULL FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'order', o_orderkey, 'open', NULL FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000
""")
def q50_union_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three sources as one list."""
    a = table(spark, sf_dir, "documents").where("n_chars > 8000").select(F.lit("document").alias("kind"), F.col("doc_id").alias("subject"), F.lit("long").alias("code"), F.col("n_chars").alias("amount"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("subject"), F.lit("in_debt").alias("code"))
    c = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_totalprice > 400000").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("subject"), F.lit("open").alias("code"))
    return sets.stacked(a, b, c)
