"""Reports and copies that a run leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assets import at_risk


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON line for each document, nulls left out, tokens never written."""
    held = [c for c in reports.columns if c != "tokens"]
    reports.select(F.to_json(F.struct(*held)).alias("value")).write.mode("overwrite").text(path)


def redacted(manifest: DataFrame, keep: tuple[str, ...] = ("document", "pages", "elements", "assets", "fonts")) -> DataFrame:
    """A manifest's counts and codes, without any text of the document: of each warning its code and place."""
    warnings = F.transform("warnings", lambda w: F.struct(w["code"].alias("code"), w["page"].alias("page"), w["element"].alias("element")))
    return manifest.select(*[c for c in keep if c in manifest.columns], warnings.alias("warnings"))


def write_at_risk(assets: DataFrame, path: str) -> dict[str, int]:
    """Write the assets that would not be drawn by themselves, under their names; how many were written, left out and failed.

    assets: kind, mime, file_name, content. An asset without content counts as failed and stops nothing.
    """
    marked = assets.withColumn("__risk", at_risk(F.col("kind"), F.col("mime"))).withColumn("__held", F.col("content").isNotNull())
    counts = marked.agg(F.count(F.when(F.col("__risk") & F.col("__held"), 1)).alias("written"), F.count(F.when(~F.col("__risk"), 1)).alias("left_out"), F.count(F.when(F.col("__risk") & ~F.col("__held"), 1)).alias("failed")).first()
    marked.where("__risk and __held").select("file_name", "content").write.mode("overwrite").parquet(path)
    return counts.asDict()
