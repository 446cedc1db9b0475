"""Queries over texts, contents and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure, text
from ..operators import fonts, inventory, ordered, sets
from .registry import query, table, tokens_sql


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)")
def q01_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct words of each document."""
    words = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query(f"""
WITH placed AS (SELECT doc_id, {tokens_sql('text')} AS w, row_number() OVER (ORDER BY doc_id) AS pos FROM documents),
counts AS (SELECT pos, t, count(*) AS n FROM (SELECT pos, unnest(w) AS t FROM placed) GROUP BY pos, t),
short AS (SELECT s.pos + 1 AS pos, sum(greatest(s.n - coalesce(d.n, 0), 0)) AS missing FROM counts s LEFT JOIN counts d ON d.pos = s.pos + 1 AND d.t = s.t GROUP BY s.pos)
SELECT p.doc_id, CAST(missing AS BIGINT) AS missing_tokens, 'content_changed' AS code FROM placed p JOIN short USING (pos) WHERE missing > 0
""")
def q02_missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, how many words of its predecessor are missing from it."""
    docs = ordered.positions(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "pos")
    counts = inventory.token_counts(docs, ["pos"], "text")
    missing = inventory.missing_tokens(counts.withColumn("pos", F.col("pos") + 1), counts, ["pos"])
    return docs.select("doc_id", "pos").join(missing, "pos").where("missing_tokens > 0").select("doc_id", "missing_tokens", F.lit("content_changed").alias("code"))


@query(f"""
SELECT token, CAST(count(*) AS BIGINT) AS surplus FROM (
    SELECT unnest({tokens_sql('text')}) AS token FROM documents WHERE lang = 'en'
    EXCEPT ALL SELECT unnest({tokens_sql('text')}) FROM benchmark) GROUP BY token
""")
def q03_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words, each as often as the benchmark is short of it."""
    words = lambda df: df.select(F.explode(text.tokens(F.col("text"))).alias("token"))
    # Counted before the subtraction: the same rows as EXCEPT ALL, without a row for every word.
    a = words(table(spark, sf_dir, "documents").where("lang = 'en'")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    b = words(table(spark, sf_dir, "benchmark")).groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    left = F.col("n") - F.coalesce("m", F.lit(0))
    return a.join(b, "token", "left").where(left > 0).select("token", left.alias("surplus"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_member, list_sort(list(doc_id)) AS members, count(*) AS n_members FROM documents GROUP BY 1")
def q04_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts with their documents."""
    return inventory.content_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL")
def q05_element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by role, through the map that the report holds."""
    held = inventory.count_map(table(spark, sf_dir, "conversations"), ["conv_id"], "role")
    return held.select("conv_id", F.explode("counts").alias("role", "n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def q06_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH per_order AS (
    SELECT l_orderkey, max(l_linenumber) AS max_line, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1)
SELECT o_custkey AS custkey, max(max_line) AS max_line, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_returned) AS BIGINT) AS n_returned,
    CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(max_line * n_lines) AS BIGINT) AS grid FROM orders JOIN per_order ON o_orderkey = l_orderkey GROUP BY 1
""")
def q07_two_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by order, orders by customer."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("max_line"), F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_returned"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    )
    own = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return own.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.max("max_line").alias("max_line"), F.sum("n_lines").alias("n_lines"), F.sum("n_returned").alias("n_returned"), F.sum("cents").alias("cents"), F.sum(F.col("max_line") * F.col("n_lines")).alias("grid")
    )


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q08_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q09_cube_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_suppkey, l_returnflag AS mode, n FROM (
    SELECT l_suppkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1
""")
def q10_mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent return flag of each supplier; of equals the first by name."""
    return inventory.first_mode(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", ["l_returnflag"])


@query("""
SELECT event_type, k, count(*) AS "count", list_sort(list(DISTINCT user_id + 1)) AS pages, min_by(user_id, event_id) AS status
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type, k
""")
def q11_note_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and property, with the users they touch."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return inventory.note_summary(events, ["event_type", "k"], "user_id", "user_id", "event_id")


@query("""
SELECT p.page_id, m.url AS href, regexp_matches(m.url, '^https?://') AS external, p.page_id IS NOT NULL AND NOT regexp_matches(m.url, '^https?://') AS internal
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS url FROM pages) m JOIN pages p USING (page_id)
""")
def q37_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of anchors, and whether they leave the site."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    external = F.rlike("href", F.lit("^https?://"))
    return links.select("page_id", "href", external.alias("external"), (~external).alias("internal"))


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query,
    CASE WHEN regexp_matches(url, '^[a-z]+://(www|m)\.') THEN 'front' WHEN regexp_matches(url, '^[a-z]+://blog\.') THEN 'blog' ELSE 'other' END AS kind FROM pages
""")
def q38_url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of page addresses, and their kind by host."""
    kind = F.when(F.rlike("url", F.lit(r"^[a-z]+://(www|m)\.")), "front").when(F.rlike("url", F.lit(r"^[a-z]+://blog\.")), "blog").otherwise("other")
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]*)").alias("host"), part("^[a-z]+://[^/?#]*([^?#]*)").alias("path"), part(r"\?([^#]*)").alias("query"), kind.alias("kind"))


@query("SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def q39_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages
""")
def q40_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.without_markup(F.col("html")).alias("text"))


_LETTERS = "CASE WHEN c > 18278 THEN '' ELSE (CASE WHEN c > 702 THEN chr(CAST(65 + ((c - 703) // 676) % 26 AS INT)) ELSE '' END) || (CASE WHEN c > 26 THEN chr(CAST(65 + ((c - 27) // 26) % 26 AS INT)) ELSE '' END) || chr(CAST(65 + (c - 1) % 26 AS INT)) END"


@query(f"SELECT r AS \"row\", c AS col, {_LETTERS} || CAST(r AS VARCHAR) AS ref, CAST(r AS INT) AS back_row, CAST(c AS INT) AS back_col FROM (SELECT DISTINCT l_linenumber AS r, l_orderkey % 18278 + 1 AS c FROM lineitem)")
def q41_a1_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreadsheet references of (line, order), there and back."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("row"), (F.col("l_orderkey") % 18278 + 1).alias("col")).distinct()
    cells = cells.withColumn("ref", F.concat(text.column_letters(F.col("col")), F.col("row").cast("string")))
    return cells.select("row", "col", "ref", text.reference_row(F.col("ref")).alias("back_row"), text.reference_column(F.col("ref")).alias("back_col"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-](?:[0-9]{4}|[0-9]{2})\b')) AS BIGINT) AS n_dates, regexp_full_match(text, '\s*[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-]([0-9]{2}|[0-9]{4})\s*') AS whole FROM documents")
def q42_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as text."""
    found = F.regexp_extract_all("text", F.lit(text.DATE_INSIDE), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_dates"), text.is_text_date(F.col("text")).alias("whole"))


@query("SELECT DISTINCT l_quantity AS quantity, CAST(round_even(l_quantity * 12700, 0) AS BIGINT) AS emu, l_quantity * 12700 / 36000 AS mm, round_even(l_quantity * 12700 / 36000 * 10, 0) / 10 AS mm_1, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def q43_unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to EMU to millimetres, rounded half to even."""
    q = F.col("l_quantity")
    mm = measure.emu_to_mm(q * measure.EMU_PER_POINT)
    return table(spark, sf_dir, "lineitem").select(q.alias("quantity"), measure.points_to_emu(q).alias("emu"), mm.alias("mm"), measure.half_even(mm, 1).alias("mm_1"), measure.half_even(q / 2).alias("half")).distinct()


@query("""
SELECT p_partkey, max(step) AS step FROM (SELECT p_partkey, p_size, p_retailprice, unnest(list_transform(range(0, CAST(greatest(0, floor((p_size - 6) / 0.5)) AS BIGINT) + 1), lambda k: p_size - k * 0.5)) AS step FROM part WHERE p_size >= 6) s
WHERE step * step * 2 <= p_retailprice GROUP BY p_partkey
""")
def q44_fit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest size, by halves down to 6, whose doubled square fits the price."""
    fit = measure.largest_step(lambda s: s * s * 2 <= F.col("p_retailprice"), F.col("p_size").cast("double"), 6.0, 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", fit.alias("step")).where("step is not null")


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def q51_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates by a property read from JSON as a map."""
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").withColumn("k", props["k"].cast("int")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.countDistinct("user_id").alias("users"))


@query("SELECT p_partkey, word FROM part, (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part) WHERE lower(p_name) = lower(word) OR starts_with(lower(p_name), lower(word) || ' ')")
def q52_label_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name begins with a word, as a whole; by the first word, so that it is an equi-join."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.split("p_name", " ")[0].alias("word")).distinct()
    heads = part.select("p_partkey", "p_name", F.lower(F.split("p_name", " ")[0]).alias("head"))
    both = heads.join(words, F.col("head") == F.lower("word"))
    return both.where(text.label_starts_with_word(F.col("p_name"), F.col("word"))).select("p_partkey", "word")


@query("SELECT doc_id, n_chars = length(text) AS length_agrees, sha256(text) AS sha256, length(text) AS n FROM documents")
def q53_hash_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the declared lengths hold, and the hashes to hold others against."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") == F.length(t)).alias("length_agrees"), F.sha2(t, 256).alias("sha256"), F.length(t).cast("long").alias("n"))


@query("SELECT lang, replace(lower(source), 'ß', 'ss') AS source_key, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def q14_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each language and folded source."""
    docs = table(spark, sf_dir, "documents").select("lang", text.folded(F.col("source")).alias("source_key"), "doc_id")
    return ordered.first_of(docs, ["lang", "source_key"], ["doc_id"])


@query("""
SELECT replace(lower(trim(p_brand)), 'ß', 'ss') AS key, replacement, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT p_brand AS b, min(p_type) AS replacement FROM part GROUP BY 1 HAVING max(p_size) > 45) ON b = p_brand GROUP BY 1, 2
""")
def q56_substitution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often lines use a brand that is replaced by one of its types."""
    part = table(spark, sf_dir, "part")
    uses = table(spark, sf_dir, "lineitem").select("l_partkey").join(part.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit(" "), "p_brand").alias("family")), "l_partkey")
    chosen = part.groupBy("p_brand").agg(F.min("p_type").alias("replacement"), F.max("p_size").alias("most")).where("most > 45")
    return fonts.substitution_counts(uses, chosen.select(text.family_key(F.col("p_brand")).alias("key"), "replacement"))


@query("SELECT p_brand, p_type, bool_or(p_size > 40) AS large, bool_or(p_retailprice > 950) AS dear FROM part GROUP BY ALL")
def q57_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (brand, type) with flags that hold anywhere."""
    part = table(spark, sf_dir, "part").withColumn("large", F.col("p_size") > 40).withColumn("dear", F.col("p_retailprice") > 950)
    return inventory.requirements(part, ["p_brand", "p_type"], ["large", "dear"])


@query("""
SELECT 'left' AS side, o_custkey AS custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'right', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def q58_set_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of one of two states only."""
    of = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("custkey"))
    return sets.differences(of("F"), of("P"))


@query("SELECT event_type, count(*) AS usage_count, min_by(user_id, event_id) AS first_page, min(event_id) AS first_event FROM events GROUP BY 1")
def q59_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.usage(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id")


@query("""
SELECT n_regionkey, CASE WHEN n <= 3 THEN array_to_string(l, ', ') ELSE array_to_string(l[1:3], ', ') || ' and ' || CAST(n - 3 AS VARCHAR) || ' more' END AS phrase
FROM (SELECT n_regionkey, list(lpad(CAST(n_nationkey AS VARCHAR), 3, '0') ORDER BY n_nationkey) AS l, count(*) AS n FROM nation GROUP BY 1)
""")
def q60_list_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-padded numbers in a row, three at most."""
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(text.zero_padded(F.col("n_nationkey"), F.lit(3)))).alias("l"))
    return own.select("n_regionkey", text.listed(F.col("l")).alias("phrase"))

