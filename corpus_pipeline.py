"""The corpus pipeline: documents by language, without near copies, repeated passages and benchmark text, as token ids.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and keeps the columns of
documents; the last gives ids. A stage's rows are written as Parquet and read again by the next.

In all stages: extra columns stay as they are, whatever their names (the last drops them); an empty table gives no rows; texts
are taken whole, whatever their length, and one must fit in a Python worker. Null and empty texts go in the first stage. Rows
that repeat an id are one group of copies in the second, where the one with the smallest text stays, as are ties of any kind:
the smallest id stays. Rows without an id count as one id there, kept only if no row of their group has one; the third stage
neither takes text from them nor from others because of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, langid, pieces, simhash, suffix_dedup
from folioscope.llm.common import read, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a text or a letter are rejected, and so are those like no language learnt."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = langid.identify(whole, langid.trained_on(docs), "row")
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0))
    return kept.select(*[F.col("id")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked at a similarity of 0.8 of five-word shingles: the one with the smallest id."""
    return simhash.one_of_each(docs, groups=simhash.similar_documents)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that documents with smaller ids have."""
    return suffix_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of benchmark items."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return pieces.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encoding", encoding),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
