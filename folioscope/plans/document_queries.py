"""Queries that put the document operators to work on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure, text
from ..operators import assets, inventory, layout, ordered, readback, transforms
from .registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as numbered boxes of their order."""
    line = ordered.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"], "id")
    return line.select(F.col("l_orderkey").alias("page"), F.col("id").cast("long").alias("id"), F.col("l_quantity").alias("x"), F.floor(F.col("l_discount") * 1000 + 0.5).cast("double").alias("y"), (4.0 + F.col("l_linenumber")).alias("w"), (5.0 + F.floor(F.col("l_tax") * 100 + 0.5)).alias("h"), "l_returnflag", "l_linestatus")


_LINES = """
lines AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS id, l_quantity AS x, floor(l_discount * 1000 + 0.5) AS y, 4.0 + l_linenumber AS w, 5.0 + floor(l_tax * 100 + 0.5) AS h, l_returnflag, l_linestatus FROM lineitem)
"""


@query(f"""
WITH {_LINES}, n AS (SELECT page, id, row_number() OVER w AS k, lead(id) OVER w AS nid, y < lead(y) OVER w + lead(h) OVER w AND lead(y) OVER w < y + h AND x + lines.w <= lead(x) OVER w AS may FROM lines WINDOW w AS (PARTITION BY page ORDER BY y, x, id)),
s AS (SELECT *, coalesce(max(CASE WHEN NOT coalesce(may, FALSE) THEN k END) OVER (PARTITION BY page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM n)
SELECT page, id AS "left", nid AS "right" FROM s WHERE may AND (k - stop) % 2 = 1
""")
def q69_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that stand next to each other, paired greedily."""
    return layout.side_by_side(_lines(spark, sf_dir), ["page"])


@query(f"""
WITH {_LINES}, j AS (
    SELECT t.page, t.id, t.y, t.h, min(CASE WHEN o.y <= t.y + 1 AND o.y + o.h >= t.y + t.h - 1 THEN o.y + o.h WHEN o.y >= t.y + t.h - 1 THEN o.y END) AS lim
    FROM lines t LEFT JOIN lines o ON t.page = o.page AND t.id <> o.id AND t.x < o.x + o.w AND o.x < t.x + t.w WHERE t.l_returnflag = 'R' GROUP BY ALL)
SELECT page, id, greatest(h, least(190.0, coalesce(lim, 190.0)) - y - 2) AS room FROM j
""")
def q70_room_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each returned line's box may grow downwards."""
    elements = _lines(spark, sf_dir).withColumn("kind", F.when(F.col("l_returnflag") == "R", "table").otherwise("text"))
    return layout.room_below(elements, ["page"], F.lit(200.0))


@query(f"""
WITH {_LINES} SELECT page, CASE WHEN l_linestatus = 'F' THEN 'closed' ELSE 'open' END AS parent, count(*) AS tiles, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM lines WHERE l_returnflag = 'A' GROUP BY 1, 2
""")
def q71_border_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes around accepted lines, by state."""
    e = _lines(spark, sf_dir).withColumn("border", F.col("l_returnflag") == "A").withColumn("parent", F.when(F.col("l_linestatus") == "F", "closed").otherwise("open"))
    return layout.border_groups(e).select("page", "parent", "tiles", "box.*")


@query(f"""
WITH {_LINES}, s AS (SELECT page, id, x, y, row_number() OVER (PARTITION BY page ORDER BY id) AS slot, row_number() OVER (PARTITION BY page ORDER BY y, x, id) AS place, min(l_linestatus) OVER (PARTITION BY page) = max(l_linestatus) OVER (PARTITION BY page) AS same FROM lines),
p AS (SELECT page, id, CASE WHEN same THEN place ELSE slot END AS k FROM s)
SELECT s.page, s.id AS slot, p.id AS object FROM s JOIN p ON s.page = p.page AND s.slot = p.k
""")
def q72_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by position where an order's lines share one state."""
    slots = _lines(spark, sf_dir).select("page", F.col("id").alias("slot"), "id", F.col("l_linestatus").alias("frame"), "x", "y")
    return layout.reading_order(slots, ["page"])


@query("""
SELECT l_orderkey AS page, l_linenumber AS col, l_partkey, 10 + sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING) AS "right" FROM lineitem
""")
def q73_grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of columns as wide as the lines' quantities."""
    line = ordered.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "col")
    out = layout.grid_edges(line.withColumn("width", F.col("l_quantity")), ["l_orderkey"], F.lit(10))
    return out.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("col"), "l_partkey", "right")


@query("SELECT l_partkey AS asset, max(CASE WHEN l_returnflag <> 'R' OR l_quantity <= 49 THEN l_quantity END) AS width, max(l_linenumber) AS height, bool_or(l_returnflag = 'R' AND l_quantity > 49) AS unknown FROM lineitem GROUP BY 1")
def q74_needed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest use of each part; a large returned line states no width."""
    odd = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset"), F.when(~odd, F.col("l_quantity")).alias("width"), F.col("l_linenumber").alias("height"))
    return assets.needed_sizes(uses)


@query("""
WITH p AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN role END AS preset, length(text) AS n, turn + 1 AS start FROM conversations),
l AS (SELECT *, preset IS NOT NULL AND n > 0 AS listed FROM p),
m AS (SELECT *, lag(listed) OVER w AS was, lag(preset) OVER w AS pre FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CASE WHEN listed AND NOT (coalesce(was, FALSE) AND coalesce(pre = preset, FALSE)) THEN 1 ELSE 0 END AS new FROM m)
SELECT conv_id, turn, CASE WHEN listed THEN CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS run, listed AND NOT coalesce(was, FALSE) AND start > 1 AS restart_note FROM r
""")
def q75_list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as list paragraphs, by role."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("preset"), F.length("text").alias("length"), (F.col("turn") + 1).alias("start"))
    return transforms.list_numbers(turns, ["conv_id"], "turn").select("conv_id", "turn", F.col("run").cast("long").alias("run"), "restart_note")


@query("""
WITH b AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'table' WHEN 'user' THEN 'picture' ELSE 'text' END AS kind FROM conversations),
t AS (SELECT p.conv_id, p.turn, min(q.turn) AS "table" FROM b p JOIN b q ON p.conv_id = q.conv_id AND q.kind = 'table' AND q.turn > p.turn WHERE p.kind = 'picture' GROUP BY 1, 2)
SELECT conv_id, turn, "table" FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = t.conv_id AND b.turn > t.turn AND b.turn < t."table" AND b.kind = 'text')
""")
def q76_pictures_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns in an unbroken run right before an assistant's."""
    kind = F.when(F.col("role") == "assistant", "table").when(F.col("role") == "user", "picture").otherwise("text")
    return transforms.pictures_above(table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind")), ["conv_id"], "turn")


@query("""
WITH s AS (SELECT o_custkey AS deck, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_totalprice AS width FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT o_custkey AS deck, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_totalprice AS width FROM orders WHERE o_orderstatus = 'O')
SELECT deck, 'slide_missing' AS code, position FROM s LEFT JOIN r USING (deck, position) WHERE r.width IS NULL
UNION ALL SELECT deck, 'slide_extra', position FROM r LEFT JOIN s USING (deck, position) WHERE s.width IS NULL
UNION ALL SELECT deck, 'page_size_changed', position FROM s JOIN r USING (deck, position) WHERE abs(s.width - r.width) > 0.1
""")
def q77_deck_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's finished orders against the open ones, place by place."""

    def deck(status: str) -> DataFrame:
        own = ordered.numbered(table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status), ["o_custkey"], ["o_orderkey"], "position")
        zero = F.lit(0)
        return own.select(F.col("o_custkey").alias("deck"), F.col("position").cast("long").alias("position"), F.col("o_totalprice").alias("width"), F.lit(1.0).alias("height"), *[zero.alias(c) for c in ("n_images", "n_tables", "n_charts", "missing_tokens")])

    return readback.deck_findings(deck("F"), deck("O"))


@query("""
SELECT DISTINCT l_quantity AS q, CAST(l_quantity AS DOUBLE) * 72 AS inches, CAST(l_quantity AS DOUBLE) / 20 AS twips, CAST(l_quantity AS DOUBLE) AS percent FROM lineitem
""")
def q78_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities written with units, and read back."""
    q = F.col("l_quantity")
    word = q.cast("string")
    return table(spark, sf_dir, "lineitem").select(q.alias("q"), measure.length_in_points(F.concat(word, F.lit("in"))).alias("inches"), measure.length_in_points(word).alias("twips"), measure.percentage(F.concat(word, F.lit("%"))).alias("percent")).distinct()


@query("""
WITH p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'IMAGE/JPEG; q=1' WHEN 2 THEN 'image/tiff' END AS mime, CASE WHEN p_size % 5 > 0 THEN p_size * 500 END AS side FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND side * side <= 25000000 THEN 'as_is' WHEN p_size % 3 > 0 THEN 'convert' ELSE 'refused' END AS fate, p_size % 7 = 0 OR p_partkey % 4 > 1 AS risk
FROM p
""")
def q79_usable_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures of some media types and sizes, some not stated: what may be sent as it is, and what is at risk."""
    n, side = F.col("p_partkey") % 4, F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("long") * 500)
    mime = F.when(n == 0, "image/png").when(n == 1, "IMAGE/JPEG; q=1").when(n == 2, "image/tiff")
    kind = F.when(F.col("p_size") % 7 == 0, "video").otherwise("image")
    return table(spark, sf_dir, "part").select("p_partkey", assets.usable(mime, side, side, F.lit(1), F.col("p_size") % 3 > 0).alias("fate"), assets.at_risk(kind, mime).alias("risk"))


@query("SELECT l_orderkey, max_line, CASE WHEN n > 1 THEN n ELSE 0 END AS populated, max_line * n AS grid FROM (SELECT l_orderkey, max(l_linenumber) AS max_line, count(*) AS n FROM lineitem GROUP BY 1)")
def q80_sheet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets of cells, by their references."""
    ref = F.concat(text.column_letters(F.col("l_linenumber").cast("long")), F.lit("1"))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", text.reference_column(ref).alias("col")).groupBy("l_orderkey").agg(F.max("col").alias("max_line"), F.count(F.lit(1)).alias("n"))
    return own.select("l_orderkey", "max_line", F.when(F.col("n") > 1, F.col("n")).otherwise(0).alias("populated"), (F.col("max_line") * F.col("n")).alias("grid"))


@query("SELECT o_orderkey, status, error, (status IN (408, 429, 500, 502, 503, 504) OR error) AS again FROM (SELECT o_orderkey, CAST(400 + o_orderkey % 110 AS INT) AS status, o_orderkey % 13 = 0 AS error FROM orders)")
def q81_may_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls may be made again."""
    calls = table(spark, sf_dir, "orders").select("o_orderkey", (400 + F.col("o_orderkey") % 110).cast("int").alias("status"), (F.col("o_orderkey") % 13 == 0).alias("error"))
    return calls.withColumn("again", readback.may_retry(F.col("status"), F.col("error")))


@query("SELECT conv_id, list_sort(list(role || ':' || CAST(n AS VARCHAR))) AS counts FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY 1")
def q82_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counts-only report of each conversation."""
    held = inventory.count_map(table(spark, sf_dir, "conversations"), ["conv_id"], "role")
    return held.select("conv_id", F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))).alias("counts"))
