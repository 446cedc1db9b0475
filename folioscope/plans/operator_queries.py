"""Queries that put the column functions and the smaller operators to work on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure, text
from ..operators import graph, layout, sets, transforms
from .document_queries import _LINES, _lines
from .registry import query, table


def _point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


@query(r"""
SELECT p_partkey, replace(lower(trim(regexp_replace(regexp_replace('"' || p_name || '  ' || p_type || '''', '^["'']+|["'']+$', '', 'g'), '\s+', ' ', 'g'))), 'ß', 'ss') AS family_key FROM part
""")
def q83_family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as font families, quoted and with blanks to squeeze."""
    return table(spark, sf_dir, "part").select("p_partkey", text.family_key(F.concat(F.lit('"'), "p_name", F.lit("  "), "p_type", F.lit("'"))).alias("family_key"))


@query("SELECT p_partkey, trim(p_name) AS head FROM part")
def q84_list_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several font names."""
    return table(spark, sf_dir, "part").select("p_partkey", text.list_head(F.concat(F.lit(" "), "p_name", F.lit(" , "), "p_type", F.lit(", serif"))).alias("head"))


@query(r"""
SELECT c_custkey, c_name || '.' || c_mktsegment AS base_name, lower(trim(c_name || '.' || c_mktsegment)) AS file_key, lower('.' || c_mktsegment) AS extension,
    left(trim(regexp_replace(regexp_replace('x:' || c_name || '?' || c_mktsegment || '*', '[\x00-\x1f\x7f<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g')), 80) AS clean FROM customer
""")
def q85_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files in folders of either slash."""
    path = F.concat(F.lit("a/b\\c\\"), "c_name", F.lit("."), "c_mktsegment")
    dirty = F.concat(F.lit("x:"), "c_name", F.lit("?"), "c_mktsegment", F.lit("*"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.base_name(path).alias("base_name"), text.file_key(path).alias("file_key"), text.extension(path).alias("extension"), text.clean_file_name(dirty).alias("clean"))


@query(r"SELECT p_partkey, left('obj_' || regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9_:\-]', '_', 'g'), 50) AS object_id FROM part")
def q86_object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of drawn objects from part names."""
    return table(spark, sf_dir, "part").select("p_partkey", text.object_id("obj_", F.concat("p_name", F.lit(" / "), "p_type")).alias("object_id"))


@query("SELECT doc_id, md5(url_encode(text)) AS encoded FROM documents")
def q87_percent_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document percent-encoded as for a signature."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.rfc3986(F.col("text"))).alias("encoded"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{fffc}]', '', 'g')) AS printable FROM documents")
def q88_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without control characters and object marks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.printable(F.col("text"))).alias("printable"))


@query("SELECT o_orderkey, CAST((o_orderkey % 3) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 47 AS INT) AS marked, CAST(o_orderkey % 997 AS INT) AS bare, CAST(NULL AS INT) AS none FROM orders")
def q89_start_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of start marks made from order numbers."""
    n = lambda k: (F.col("o_orderkey") % k).cast("string")
    marked = F.concat(n(3), F.lit("h"), n(60), F.lit("m"), n(47), F.lit("s"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.seconds_of(marked).alias("marked"), text.seconds_of(n(997)).alias("bare"), text.seconds_of(F.concat(F.lit("x"), n(3))).cast("int").alias("none"))


@query("SELECT o_orderkey, printf('#%02x%02x%02x', (o_orderkey * 7919) % 256, ((o_orderkey * 7919) >> 8) % 256, ((o_orderkey * 7919) >> 16) % 256) AS colour FROM orders")
def q90_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers as colours whose low byte is red."""
    return table(spark, sf_dir, "orders").select("o_orderkey", text.rgb_of_bgr(F.col("o_orderkey") * 7919).alias("colour"))


@query("SELECT p_partkey, p_name || ' ' || p_type || chr(10) || p_brand AS joined FROM part")
def q91_continued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines with a continuation mark."""
    return table(spark, sf_dir, "part").select("p_partkey", text.joined_lines(F.concat("p_name", F.lit(" _ \r\n   "), "p_type", F.lit("\n"), "p_brand")).alias("joined"))


@query("""
SELECT user_id, event_id, 'https://host.example/' || event_type || '?…' AS signed, 'https://host.example/' || event_type || '?page=1' AS plain FROM events
""")
def q92_masked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of events; what is signed loses its query."""
    link = F.concat(F.lit("https://host.example/"), "event_type", F.lit("?"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", text.signed_link_masked(F.concat(link, F.lit("a=1&X-Signature=ab12"))).alias("signed"), text.signed_link_masked(F.concat(link, F.lit("page=1"))).alias("plain"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'youtube' END AS provider, CASE WHEN o_orderkey % 3 < 2 THEN 'abcdef' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 90 AS INT) END AS start FROM orders
""")
def q93_video_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers of links made from order numbers, the last kind of which is no video."""
    ident = F.concat(F.lit("abcdef"), F.lpad((F.col("o_orderkey") % 100_000).cast("string"), 5, "0"))
    start = (F.col("o_orderkey") % 90).cast("string")
    n = F.col("o_orderkey") % 3
    url = F.when(n == 0, F.concat(F.lit("https://youtu.be/"), ident, F.lit("?t="), start)).when(n == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), ident)).otherwise(F.concat(F.lit("https://host.example/watch?v="), ident))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.video_provider(url).alias("v")).select("o_orderkey", "v.provider", "v.id", F.when(F.col("o_orderkey") % 3 < 2, F.col("v.start")).alias("start"))


@query(f"""
WITH {_LINES}, p AS (SELECT page, id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM lines WINDOW w AS (PARTITION BY page ORDER BY id))
SELECT page, CASE WHEN count(*) >= 3 THEN sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) / 2 ELSE 0.0 END AS area, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM p GROUP BY 1
""")
def q94_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and bounds of the outline that an order's boxes span."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("id", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    own = _lines(spark, sf_dir).groupBy("page").agg(points.alias("points"))
    return own.select("page", measure.signed_area(F.col("points")).alias("area"), measure.bounds(F.col("points")).alias("b")).select("page", "area", "b.*")


@query(f"""
WITH {_LINES} SELECT page, id, 2.0 * w / 4 AS sx, CAST(3.0 AS DOUBLE) AS sy, 10 + 2.0 * (x - w / 4 * 8) AS dx, 20 + 3.0 * (y - 1.0 * 16) AS dy FROM lines
""")
def q95_group_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The space inside groups, one side of which states no extent."""
    space = F.struct(F.lit(2.0).alias("sx"), F.lit(3.0).alias("sy"), F.lit(10.0).alias("dx"), F.lit(20.0).alias("dy"))
    inner = measure.in_group(space, _point(F.col("x"), F.col("y")), _point(F.col("w"), F.col("h")), _point(8, 16), _point(4, 0))
    return _lines(spark, sf_dir).select("page", "id", inner.alias("s")).select("page", "id", "s.*")


@query(f"""
WITH {_LINES} SELECT page, id, x + 100 AS cx, y + 100 AS cy, CAST(w AS DOUBLE) AS w, h, CAST(id * 11 % 170 AS DOUBLE) AS rotation FROM lines
""")
def q96_rotated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated frames through their outlines and back."""
    frame = F.struct((F.col("x") + 100).alias("cx"), (F.col("y") + 100).alias("cy"), "w", "h", (F.col("id") * 11 % 170).cast("double").alias("rotation"))
    back = _lines(spark, sf_dir).select("page", "id", measure.frame_of_outline(measure.outline_of_frame(frame)).alias("f"))
    return back.select("page", "id", *[(F.round(F.col(f"f.{c}"), 6) + 0.0).alias(c) for c in ("cx", "cy", "w", "h", "rotation")])


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, least(1.0, l_quantity / 45) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN p < 0.2 THEN 0.5 * t * p * p / 0.2 WHEN p > 0.7 THEN 1 - 0.5 * t * (1 - p) * (1 - p) / 0.3 ELSE t * (p - 0.1) END, 9) AS eased FROM p, (SELECT 1 / (1 - 0.5 / 2) AS t)
""")
def q97_eased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress with a speed-up and a slow-down, past the end too."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(measure.eased(F.col("l_quantity") / 45, F.lit(0.2), F.lit(0.3)), 9).alias("eased"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity < 5 THEN 1.0 WHEN l_quantity < 20 THEN 1 + (l_quantity - 5) / 15 * 4 WHEN l_quantity < 40 THEN 5 - (l_quantity - 20) / 20 * 8 ELSE -3.0 END, 9) AS value FROM lineitem
""")
def q98_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between three frames at the lines' quantities."""
    frames = F.array(*[F.struct(F.lit(float(a)).alias("at"), F.lit(float(v)).alias("value")) for a, v in ((5, 1), (20, 5), (40, -3))])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(measure.keyframe_value(frames, F.col("l_quantity")), 9).alias("value"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 * 11 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(least(3.0, d / 5 * 3), 9) AS x, round(CASE WHEN d <= 5 THEN d / 5 * 4 ELSE 4 + d - 5 END, 9) AS y FROM s
""")
def q99_motion_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points along a path of two legs, by share of its length."""
    path = F.array(_point(0, 0), _point(3, 4), _point(3, 10))
    at = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", measure.point_along(path, F.col("l_quantity") / 50).alias("p"))
    return at.select("l_orderkey", "l_linenumber", "l_partkey", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query("""
WITH w AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS w, sum(l_quantity) AS total FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(w, lambda x: CASE WHEN total > 100 THEN greatest(1, CAST(round_even(x * 100 / total, 0) AS BIGINT)) ELSE CAST(x AS BIGINT) END), ',') AS widths FROM w
""")
def qa0_shrunk_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as wide as an order's quantities, in a hundred points."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["l_quantity"]).alias("w"))
    return own.select("l_orderkey", F.array_join(F.transform(measure.shrunk(F.col("w"), F.lit(100.0)), lambda x: x.cast("string")), ",").alias("widths"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 600 - l_quantity WHEN 1 THEN 50 + (510 - l_quantity) / 2 ELSE 560 + l_quantity END AS at FROM lineitem
""")
def qa1_paper_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on paper by alignment, or by offset where none is stated."""
    n = F.col("l_linenumber") % 3
    frame = F.when(n == 0, "page").when(n == 1, "margin").otherwise("right_margin")
    align = F.when(n == 0, "right").when(n == 1, "center")
    at = measure.paper_offset(frame, align, F.col("l_quantity"), F.col("l_quantity"), F.lit(600), F.lit(50), F.lit(40))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", at.alias("at"))


@query(f"""
WITH {_LINES}, s AS (SELECT page, id, l_returnflag, x * 9000 AS x, y * 900 AS y, 1000 + w AS w, 1000 + h AS h FROM lines)
SELECT page, id, EXISTS (SELECT 1 FROM s b WHERE b.page = a.page AND b.l_returnflag = 'N' AND abs(a.x - b.x) <= 54864 AND abs(a.y - b.y) <= 54864 AND abs(a.w - b.w) <= 0.03 * greatest(a.w, b.w) AND abs(a.h - b.h) <= 0.03 * greatest(a.h, b.h)) AS coincident
FROM s a WHERE l_returnflag = 'R'
""")
def qa2_coincident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines' boxes that lie on a box of an open line."""
    own = _lines(spark, sf_dir).select("page", "id", "l_returnflag", (F.col("x") * 9000).alias("x"), (F.col("y") * 900).alias("y"), (1000 + F.col("w")).alias("w"), (1000 + F.col("h")).alias("h"))
    return layout.near_coincident(own.where("l_returnflag = 'R'").drop("l_returnflag"), own.where("l_returnflag = 'N'"), ["page"]).select("page", "id", "coincident")


@query(f"""
WITH {_LINES} SELECT a.page, a.id, min(b.id) AS table_id FROM lines a JOIN lines b ON a.page = b.page AND a.l_returnflag = 'R' AND b.l_returnflag <> 'R' AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h GROUP BY 1, 2
""")
def qa3_first_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first box of another line that a returned line's box overlaps."""
    own = _lines(spark, sf_dir).select("page", "id", F.col("id").alias("ord"), F.struct("x", "y", "w", "h").alias("box"), "l_returnflag")
    return layout.first_overlap(own.where("l_returnflag = 'R'"), own.where("l_returnflag <> 'R'"), ["page"])


@query(f"""
WITH {_LINES} SELECT a.page, a.id, b.id AS front FROM lines a JOIN lines b ON a.page = b.page AND b.id > a.id WHERE b.l_returnflag <> 'A' AND b.x < 40 AND b.w <> 6
""")
def qa4_in_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible pictures and shapes above each box."""
    own = _lines(spark, sf_dir).withColumn("z", F.col("id")).withColumn("visible", F.col("x") < 40).withColumn("border", F.col("w") == 6)
    return layout.in_front(own.withColumn("kind", F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "R", "shape").otherwise("image")), ["page"])


@query("""
WITH m AS (SELECT conv_id, turn AS place, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS inside, CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END AS "before", CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END AS ends, conv_id % 2 = 0 AS rendered FROM conversations)
SELECT a.conv_id, a.place AS a, b.place AS b, CASE
    WHEN a.place = b.place THEN CASE WHEN a.inside > 0 THEN 'unknown' ELSE 'same' END
    WHEN (SELECT coalesce(sum(x.inside + x."before" + x.ends), 0) FROM m x WHERE x.conv_id = a.conv_id AND x.place > a.place AND x.place < b.place) > 0 OR a.ends > 0 OR b."before" > 0 THEN 'different'
    WHEN a.inside > 0 OR b.inside > 0 THEN 'unknown'
    WHEN NOT a.rendered AND b.place - a.place > 3 THEN 'unknown' ELSE 'same' END AS relation
FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.place BETWEEN a.place AND a.place + 5
""")
def qa5_page_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether turns near each other stand on one page, by break marks made from their texts."""
    n = F.length("text")
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), (F.col("role") == "system").cast("int").alias("inside"), (n % 5 == 0).cast("int").alias("before"), (n % 7 == 0).cast("int").alias("ends"), (F.col("conv_id") % 2 == 0).alias("rendered"))
    near = own.select("conv_id", F.col("place").alias("a"), F.explode(F.sequence("place", F.col("place") + 5)).alias("b")).join(own.select("conv_id", F.col("place").alias("b")), ["conv_id", "b"], "left_semi")
    return layout.page_relation(near, own, "conv_id").select("conv_id", "a", "b", "relation")


@query("""
WITH e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 7 % 1000 END AS parent, o_custkey AS ord FROM orders)
SELECT e.id, e.parent, e.ord FROM e LEFT JOIN (SELECT id, min(ord) AS ord FROM e GROUP BY 1) p ON p.id = e.parent WHERE e.parent IS NOT NULL AND (p.ord IS NULL OR p.ord >= e.ord)
""")
def qa6_forward_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as elements whose parent does not come before them."""
    key = F.col("o_orderkey")
    return graph.forward_parents(table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 3 > 0, key * 7 % 1000).alias("parent"), F.col("o_custkey").alias("ord"))).select("id", "parent", "ord")


@query("""
SELECT conv_id, turn, CASE WHEN turn >= 2 THEN conv_id * 10 + 2 WHEN turn = 1 THEN conv_id * 10 END AS anchor FROM conversations
""")
def qa7_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ancestor of a tag, on paths as long as the turn's number."""
    node = lambda k: F.struct((F.col("conv_id") * 10 + k).alias("id"), F.when(k % 2 == 0, "anchor").otherwise("run").alias("tag"))
    path = F.slice(F.transform(F.sequence(F.lit(0), F.lit(2)), node), 1, F.least(F.col("turn").cast("int") + 1, F.lit(3)))
    own = table(spark, sf_dir, "conversations").withColumn("path", F.when(F.col("turn") > 0, path).otherwise(F.slice(path, 1, 0)))
    return own.select("conv_id", "turn", graph.ancestor(F.col("path"), "anchor").alias("anchor"))


@query("SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT role, count(*) FROM conversations GROUP BY 1 UNION ALL SELECT event_type, 1 FROM events WHERE value > 50) GROUP BY 1")
def qa8_summed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of three reports, added up."""
    events, turns = table(spark, sf_dir, "events"), table(spark, sf_dir, "conversations")
    reports = [events.groupBy(F.col("event_type").alias("kind")).count(), turns.groupBy(F.col("role").alias("kind")).count(), events.where("value > 50").select(F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("count"))]
    return sets.summed(*[r.withColumnRenamed("count", "n") for r in reports], key="kind", value="n")


@query(f"""
WITH {_LINES}, e AS (SELECT page, id, CASE WHEN l_returnflag = 'N' THEN 'a' ELSE 'b' END AS parent, CASE WHEN l_linestatus = 'F' AND id = 5 THEN 'layer' ELSE 'shape' END AS kind, x, y, w, h FROM lines),
big AS (SELECT page, parent, x AS bx, y AS by_, w AS bw, h AS bh FROM (SELECT *, row_number() OVER (PARTITION BY page, parent ORDER BY w * h DESC, id) AS k FROM e) WHERE k = 1),
j AS (SELECT *, greatest(3.0, 0.05 * greatest(bw, bh)) AS s FROM e JOIN big USING (page, parent))
SELECT page, parent AS layer, bool_or(kind = 'layer' OR x < bx - s OR y < by_ - s OR x + w > bx + bw + s OR y + h > by_ + bh + s) AS authored FROM j GROUP BY 1, 2
""")
def qa9_authored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of an order's boxes that look like groups their author made."""
    parent = F.when(F.col("l_returnflag") == "N", "a").otherwise("b")
    kind = F.when((F.col("l_linestatus") == "F") & (F.col("id") == 5), "layer").otherwise("shape")
    return transforms.authored_groups(_lines(spark, sf_dir).withColumn("parent", parent).withColumn("kind", kind), ["page"])


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, n_regionkey + 30 FROM nation),
w(a, b, hops) AS (SELECT a, b, 1 FROM e UNION SELECT w.a, e.b, hops + 1 FROM w JOIN e ON e.a = w.b WHERE hops < 30)
SELECT a, b, min(hops) AS hops FROM w GROUP BY 1, 2
""")
def qb0_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways between nations along a rule with cycles, and to their regions, with the fewest steps."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return graph.closure(nation.select(key.alias("a"), ((key * 3 + 1) % 25).alias("b")).unionByName(nation.select(key.alias("a"), (F.col("n_regionkey") + 30).alias("b"))))


@query("""
WITH RECURSIVE j AS (SELECT p_name || CASE WHEN p_partkey % 50 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS name, p_partkey FROM part),
known AS (SELECT name, count(*) AS n FROM j GROUP BY 1),
t AS (SELECT j.name, k.name AS target, k.name IS NULL AS lost FROM j LEFT JOIN (SELECT name, p_partkey FROM j) k ON k.p_partkey = CASE WHEN j.p_partkey % 10 < 5 THEN (j.p_partkey - j.p_partkey % 10) + (j.p_partkey + 1) % 5 END),
e AS (SELECT DISTINCT name AS a, target AS b FROM t WHERE target IS NOT NULL),
w(a, b, hops) AS (SELECT a, b, 1 FROM e UNION SELECT w.a, e.b, hops + 1 FROM w JOIN e ON e.a = w.b WHERE hops < 12)
SELECT name, CASE WHEN n > 1 THEN 'duplicate' ELSE 'ready' END AS status, (SELECT count(DISTINCT target) FROM t WHERE t.name = known.name) AS n_dependencies, (SELECT count(*) FROM t WHERE t.name = known.name AND lost) AS unresolved, name IN (SELECT a FROM w WHERE a = b) AS cyclic FROM known
""")
def qb1_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as jobs that wait for others, some in rings, some for files that are not there."""
    key = F.col("p_partkey")
    jobs = table(spark, sf_dir, "part").select(key, F.concat("p_name", F.when(key % 50 == 0, "").otherwise(key.cast("string"))).alias("name"))
    to = F.when(key % 10 < 5, key - key % 10 + (key + 1) % 5)
    named = jobs.select(key.alias("to"), F.col("name").alias("found"))
    targets = jobs.withColumn("to", to).join(named, "to", "left").select("name", F.coalesce("found", F.lit("not there")).alias("target"))
    return graph.batch_plan(jobs.select("name"), targets)


_BLOCKS = """
b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS id, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'R' THEN 'page_break' ELSE 'empty' END AS kind FROM lineitem)
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the blocks of a document: tables, page breaks and empty paragraphs."""
    kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "R", "page_break").otherwise("empty")
    return _lines(spark, sf_dir).withColumn("kind", kind)


@query(f"""
WITH {_BLOCKS} SELECT page, id, kind = 'empty' AND coalesce(lag(kind) OVER w = 'table' AND lead(kind) OVER w IN ('table', 'page_break'), FALSE) AS between_tables FROM b WINDOW w AS (PARTITION BY page ORDER BY id)
""")
def qb2_between_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty paragraphs that keep two tables apart."""
    return transforms.empty_between_tables(_blocks(spark, sf_dir), ["page"], "id").select("page", "id", "between_tables")


@query(f"""
WITH {_LINES} SELECT page, id FROM lines WHERE x <= 30 AND NOT (h > 10 OR w = 6 OR y = 0 OR id = 1) AND x > 10
""")
def qb3_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that a pass emptied and that nothing needs."""
    own = _lines(spark, sf_dir)
    after = own.select("page", "id", (F.col("x") <= 30).alias("empty"), (F.col("h") > 10).alias("has_section"), (F.col("w") == 6).alias("only_in_container"), (F.col("y") == 0).alias("last_of_required"), (F.col("id") == 1).alias("between_tables"))
    return transforms.emptied(own.select("page", "id", (F.col("x") <= 10).alias("empty")), after, ["page"])


@query("""
SELECT l_orderkey AS page, l_linenumber AS row FROM lineitem GROUP BY ALL HAVING bool_or(l_returnflag = 'R') AND NOT coalesce(max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) > 30, FALSE)
""")
def qb4_protected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that gained a picture no taller than a page, where its height is known."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row"), (F.col("l_returnflag") == "R").alias("gained"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("picture_height"))
    return transforms.protected_rows(cells, ["page"], F.lit(30.0))


@query("""
SELECT conv_id, coalesce(min_by(length(text) % 2 = 0, turn) FILTER (WHERE role = 'user' AND length(text) % 3 > 0), conv_id % 2 = 0) AS right_to_left FROM conversations GROUP BY conv_id
""")
def qb5_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of conversations: what the first turn that states one says, else the anchor's."""
    n = F.length("text")
    said = table(spark, sf_dir, "conversations").withColumn("rtl", F.when((F.col("role") == "user") & (n % 3 > 0), n % 2 == 0))
    return transforms.direction(said, ["conv_id"], F.col("conv_id") % 2 == 0, "turn")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ink_unsupported' WHEN p_size % 3 = 0 THEN 'graphic_unsupported' WHEN p_size % 5 = 0 THEN 'textbox' WHEN p_size % 7 = 0 THEN 'picture' ELSE 'unsupported' END AS kind FROM part
""")
def qb6_anchor_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as anchored objects that may be several things at once."""
    n = F.col("p_size")
    own = table(spark, sf_dir, "part").select("p_partkey", *[(n % k == 0).alias(c) for k, c in ((2, "ink"), (3, "graphic"), (5, "textbox"), (7, "picture"))])
    return own.select("p_partkey", transforms.anchor_kind().alias("kind"))
