"""Document bundles: JSON of pages, elements, runs and assets, flattened into tables, checked, and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph

#: The bundle's logical schema, as far as the tables need it.
SCHEMA = """
schemaVersion STRING, source STRUCT<type STRING, filename STRING, sha256 STRING, byteLength BIGINT>,
document STRUCT<title STRING, pageCount INT, masterPageCount INT>,
fonts ARRAY<STRUCT<family STRING, usageCount BIGINT, firstPageIndex INT, firstEventIndex BIGINT, embedded BOOLEAN>>,
assets STRUCT<count INT, placementCount INT, ids ARRAY<STRING>>,
pages ARRAY<STRUCT<id STRING, `index` INT, kind STRING, width DOUBLE, height DOUBLE, unit STRING, warnings ARRAY<STRUCT<code STRING, message STRING>>,
  elements ARRAY<STRUCT<id STRING, type STRING, pageIndex INT, zIndex INT, parentId STRING, visible BOOLEAN, rotationDegrees DOUBLE,
    bounds STRUCT<x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, unit STRING>,
    compatibility STRUCT<status STRING, basis STRING, evidence STRING>, image STRUCT<assetId STRING, route STRING>,
    paragraphs ARRAY<STRUCT<`index` INT, listKind STRING, listLevel INT, runs ARRAY<STRUCT<`index` INT, text STRING, style MAP<STRING,STRING>>>>>>>>>
"""
STATUSES = ("NATIVE", "APPROXIMATED", "FLATTENED", "UNSUPPORTED", "IGNORED")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundles with the file they come from; what does not parse is kept in ``_corrupt``."""
    return spark.read.schema(SCHEMA + ", _corrupt STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("bundle", F.input_file_name())


def pages(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle", F.explode("pages").alias("page")).select("bundle", "page.*")


def elements(bundles: DataFrame) -> DataFrame:
    """(bundle, page, ord, element fields...): ord is the place in the page's list."""
    own = pages(bundles).select("bundle", F.col("id").alias("page_id"), F.col("index").alias("page_index"), F.col("kind").alias("page_kind"), F.posexplode("elements").alias("ord", "e"))
    return own.select("bundle", "page_id", "page_index", "page_kind", "ord", "e.*")


def runs(bundles: DataFrame) -> DataFrame:
    p = elements(bundles).select("bundle", "page_index", F.col("id").alias("element_id"), F.posexplode("paragraphs").alias("paragraph", "p"))
    return p.select("bundle", "page_index", "element_id", "paragraph", F.posexplode("p.runs").alias("run", "r")).select("bundle", "page_index", "element_id", "paragraph", "run", "r.text", "r.style")


def problems(bundles: DataFrame) -> DataFrame:
    """(bundle, code, subject) of what does not hold together in a bundle."""
    e = elements(bundles)
    row = lambda df, code, subject: df.select("bundle", F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))
    out = row(e.groupBy("bundle", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_element", "id")
    forward = graph.forward_parents(e.select(F.concat_ws("/", "bundle", "id").alias("id"), F.when(F.col("parentId").isNotNull(), F.concat_ws("/", "bundle", "parentId")).alias("parent"), (F.col("page_index") * 1_000_000 + F.col("ord")).alias("ord"), "bundle"))
    out = out.unionByName(row(forward, "forward_parent", "id"))
    out = out.unionByName(row(e.where("pageIndex <> page_index"), "page_mismatch", "id"))
    assets = bundles.select("bundle", F.explode("assets.ids").alias("asset"))
    used = e.where("image.assetId is not null").select("bundle", "id", F.col("image.assetId").alias("asset"))
    out = out.unionByName(row(used.join(assets, ["bundle", "asset"], "left_anti"), "unknown_asset", "id"))
    out = out.unionByName(row(e.where(~F.col("compatibility.status").isin(*STATUSES)), "unknown_status", "id"))
    z = e.withColumn("place", F.row_number().over(Window.partitionBy("bundle", "page_index").orderBy("ord")) - 1)
    out = out.unionByName(row(z.where("zIndex is null"), "invalid_z", "id")).unionByName(row(z.where("zIndex is not null and zIndex <> place"), "sparse_z", "id"))
    counts = bundles.select("bundle", F.col("assets.count").alias("declared"), F.size("assets.ids").alias("held"), "document.pageCount", F.size(F.filter("pages", lambda p: p["kind"] == "page")).alias("n_pages"))
    out = out.unionByName(row(counts.where("declared <> held"), "asset_count", "declared"))
    return out.unionByName(row(counts.where("pageCount <> n_pages"), "page_count", "pageCount"))


def report(bundles: DataFrame) -> DataFrame:
    """One row for each bundle with counts only: no texts, no names."""
    e = elements(bundles)
    kinds = e.groupBy("bundle", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("bundle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("elements_by_type"))
    states = e.groupBy("bundle", F.col("compatibility.status").alias("status")).agg(F.count(F.lit(1)).alias("n")).groupBy("bundle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("elements_by_status"))
    return bundles.select("bundle", F.size("pages").alias("pages"), F.size("fonts").alias("fonts"), F.col("assets.count").alias("assets")).join(kinds, "bundle", "left").join(states, "bundle", "left")


def probable_masters(bundles: DataFrame, least_pages: int = 2) -> DataFrame:
    """Elements that stand on every page with the same type, bounds (to a tenth) and asset: candidates for a master."""
    e = elements(bundles).where("bounds is not null")
    tenth = lambda c: (F.rint(F.col(c) * 10) / 10).alias(c.replace(".", "_"))
    own = e.select("bundle", "page_index", "type", *[tenth(f"bounds.{k}") for k in ("x", "y", "width", "height")], F.col("image.assetId").alias("asset"))
    keys = ["type", "bounds_x", "bounds_y", "bounds_width", "bounds_height", "asset"]
    total = own.groupBy("bundle").agg(F.countDistinct("page_index").alias("__all"))
    held = own.groupBy("bundle", *keys).agg(F.countDistinct("page_index").alias("n_pages"))
    return held.join(total, "bundle").where((F.col("n_pages") == F.col("__all")) & (F.col("__all") >= least_pages)).drop("__all")
