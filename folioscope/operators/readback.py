"""What a conversion lost: facts of the source against facts of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import findings

#: Sizes of pages may differ by a tenth of a point.
PAGE_SLACK = 0.1
#: What a product imports at most, in MiB.
IMPORT_LIMITS = {"docx": 50, "pptx": 100, "xlsx": 100}


def document_findings(facts: DataFrame, key: str = "id") -> DataFrame:
    """(key, seq, code, level) of converted documents, in a fixed order.

    facts: missing_tokens, equations, source_fields, blank_pages, floating_pictures, source_tables, tables,
    page_break_paragraphs, source_pages, pages. A count that the source does not state is not compared.
    """
    c = F.col
    return findings(
        facts,
        [key],
        [
            ("content_changed", "error", c("missing_tokens") > 0),
            ("equations_present", "review", c("equations") > 0),
            ("fields_regenerated", "review", c("source_fields") > 0),
            ("blank_pages", "review", c("blank_pages") > 0),
            ("floating_pictures", "review", c("floating_pictures") > 0),
            ("table_count_changed", "error", c("source_tables").isNotNull() & (c("source_tables") != c("tables"))),
            ("page_break_paragraphs", "info", c("page_break_paragraphs") > 0),
            ("page_count_changed", "review", F.coalesce(c("source_pages") > 0, F.lit(False)) & (c("source_pages") != c("pages"))),
        ],
    )


def deck_findings(source: DataFrame, result: DataFrame, key: str = "deck") -> DataFrame:
    """(key, code, position) of converted decks, slide by slide.

    Both: key, position, width, height, n_images, n_tables, n_charts, missing_tokens (of the result). Slides beyond the
    shorter deck count as missing or extra, and are not compared.
    """
    r = result.select(key, "position", *[F.col(c).alias(f"r_{c}") for c in ("width", "height", "n_images", "n_tables", "n_charts", "missing_tokens")])
    both = source.join(r, [key, "position"], "full")
    fewer = lambda c: F.col(f"r_{c}") < F.col(c)
    checks: list[tuple[str, Column]] = [
        ("slide_missing", F.col("r_width").isNull()),
        ("slide_extra", F.col("width").isNull()),
        ("page_size_changed", (F.abs(F.col("width") - F.col("r_width")) > PAGE_SLACK) | (F.abs(F.col("height") - F.col("r_height")) > PAGE_SLACK)),
        ("content_changed", F.col("r_missing_tokens") > 0),
        ("images_missing", fewer("n_images")),
        ("tables_missing", fewer("n_tables")),
        ("charts_missing", fewer("n_charts")),
    ]
    made = F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in checks])
    return both.select(key, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("code"), "position")


def workbook_findings(source: DataFrame, result: DataFrame, key: str = "workbook") -> DataFrame:
    """(key, code, position) of converted workbooks: sheets by place, with their names, types and visibility."""
    r = result.select(key, "position", F.col("name").alias("r_name"), F.col("kind").alias("r_kind"), F.col("state").alias("r_state"))
    both = source.join(r, [key, "position"], "full")
    checks = [("sheet_missing", F.col("r_name").isNull()), ("sheet_extra", F.col("name").isNull()), ("sheet_renamed", F.col("name") != F.col("r_name")), ("sheet_type_changed", F.col("kind") != F.col("r_kind")), ("visibility_changed", F.col("state") != F.col("r_state"))]
    made = F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in checks])
    return both.select(key, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("code"), "position")


def object_findings(planned: DataFrame, found: DataFrame, key: str = "slide") -> DataFrame:
    """(key, id, code): planned objects that are missing, or whose text differs once white space is left out."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    f = found.select(key, "id", F.col("text").alias("__text"), F.lit(True).alias("__found"))
    both = planned.join(f, [key, "id"], "left")
    code = F.when(F.col("__found").isNull(), "object_missing").when(bare(F.col("text")) != bare(F.col("__text")), "text_differs")
    return both.withColumn("code", code).where("code is not null").select(key, "id", "code")


def over_import_limit(format_: Column, size: Column) -> Column:
    """Whether a file is over what its product imports; formats without a limit never are."""
    limit = F.create_map(*[F.lit(x) for k, v in IMPORT_LIMITS.items() for x in (k, v << 20)])[format_]
    return F.coalesce(size > limit, F.lit(False))


#: Statuses after which a call may be made again.
TRANSIENT = (408, 429, 500, 502, 503, 504)


def may_retry(status: Column, transport_error: Column) -> Column:
    return F.coalesce(status.isin(*TRANSIENT), F.lit(False)) | F.coalesce(transport_error, F.lit(False))
