"""Windows over event streams: watermarks, and what they leave out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    """Events of a folder of Parquet files, with their time as a timestamp for watermarks."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, size: str, late: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by windows of ``size``; events more than ``late`` behind the latest are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("window"), *keys).agg(*aggregates)


def sliding(stream: DataFrame, size: str, step: str, late: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("window"), *keys).agg(*aggregates)


def sessions(stream: DataFrame, gap: str, late: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), *keys).agg(*aggregates)


def first_of_each(stream: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(out: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there, into a folder, and stop."""
    q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q
