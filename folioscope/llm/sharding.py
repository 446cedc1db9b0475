"""Sharding: a two-pass external shuffle in DataFrame functions alone.

Pass one scatters every record by seeded hashes: its key picks the shard, and a second hash one of the shard's
memory-sized buckets, written as the files of Spark's only exchange of records. Pass two reads bucket after bucket, puts
each through a seeded Fisher-Yates shuffle (Spark's ``shuffle``) and numbers its records after those of the buckets before
it. A bucket is the partition of its own number, whence ``shuffle`` draws its stream: slots depend on the seed and the rows
alone, not on how the input is cut, and what a lost executor held comes out alike when it is scattered anew.

The shard law is ``key``: a record goes to the shard whose seeded hash with the key is the largest. A further shard
takes rows only into itself, as it wins a key or changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc32_of, read

#: Bytes of records that a bucket may hold on average.
BUCKET_BYTES = 32 << 20


def shard_of(key: Column, shards: int, seed: int = 17) -> Column:
    """The shard, 0 to shards - 1, with the largest hash of (key, shard, seed); the lowest wins a tie. Null is a key."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    ranked = [F.struct(F.xxhash64(key, F.lit(i), F.lit(seed)).alias("h"), F.lit(-i).alias("s")) for i in range(shards)]
    return -(F.greatest(*ranked) if shards > 1 else ranked[0])["s"]


def shard_records(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every record of ``docs`` with size, law, shard, grown_shard, bucket and slot; columns so named before are replaced.

    size: UTF-8 bytes of the text (null: none) plus 1. slot: place in the shard, gapless from 0. A record without a
    key has the null key's shard. The rows of one key are spread over its shard's buckets by their texts. Repeated rows
    are kept, each with a slot of its own; repeats of one row (key and text) share a bucket. An empty table gives no rows.

    Memory: a bucket, and with it its longest text. The count of buckets grows with the bytes; a task has one.
    """
    added = ["size", "law", "shard", "grown_shard", "bucket", "slot"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    sized = F.coalesce(F.octet_length(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long") + 1
    total = docs.select(F.sum(sized).alias("n")).first()["n"] or 0
    each = max(1, -(-int(total) // (bucket_bytes * shards)))
    payload = docs.columns
    placed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in payload]).alias("record"),
        sized.alias("size"),
        shard_of(F.col(key), shards, seed).alias("shard"),
        shard_of(F.col(key), shards + 1, seed).alias("grown_shard"),
        # The salt spreads the rows of one key. It comes from the row alone, so a task that runs anew deals alike.
        F.xxhash64(F.col(key), F.col(text), F.lit(seed + 1)).alias("salt"),
    ).withColumn("bucket", (F.col("shard") * each + F.pmod("salt", F.lit(each))).cast("int"))
    scattered = placed.repartitionById(each * shards, F.col("bucket"))
    row = F.struct("salt", "size", "shard", "grown_shard", "record")
    bucketed = scattered.groupBy("bucket").agg(F.shuffle(F.array_sort(F.collect_list(row)), F.lit(seed)).alias("rows"))
    dealt = bucketed.select("bucket", F.posexplode("rows").alias("at", "row"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # One row a bucket, put where its bucket is and hashed: the join neither moves nor sorts a record, at any size.
    starts = starts.repartitionById(each * shards, F.col("bucket")).hint("shuffle_hash")
    return dealt.join(starts, "bucket").select(
        *[F.col("row.record")[c].alias(c) for c in payload],
        F.col("row.size").alias("size"),
        F.lit("key").alias("law"),
        F.col("row.shard").cast("int").alias("shard"),
        F.col("row.grown_shard").cast("int").alias("grown_shard"),
        F.col("bucket"),
        (F.col("first") + F.col("at")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards as Parquet below ``path`` (shard=N/...), each file in slot order; returns the written table."""
    out = shard_records(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, by key."""
    out = shard_records(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", crc32_of(F.col("text")).cast(T.LongType()).alias("text_crc32"), "law", "shard", "slot", "grown_shard")
