"""Sharding by jump consistent hashing, in DataFrame expressions only.

The shard follows from the key and the number of shards alone; with one more shard, the only rows that
move are those that go to the new one. Places within a shard are counted in two steps, so no task has
to hold a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a bucket, about: one task numbers the rows of a bucket of a shard.
BUCKET_ROWS = 100_000
#: Counts of buckets that are sent to all executors; more of them are joined by a shuffle.
MOST_SENT = 100_000


def jump(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key by jump consistent hashing (Lamping and Veach, 2014).

    The pseudo-random sequence of a key is xxhash64 of the key and the step. Every step moves on by one
    shard at least, so ``shards`` steps are enough; steps after the last jump change nothing.
    """
    seed = F.xxhash64(key)

    def step(at: Column, i: Column) -> Column:
        drawn = (F.shiftrightunsigned(F.xxhash64(seed, i), 33) + 1).cast("double") / F.lit(float(1 << 31))
        to = F.floor((at["to"] + 1).cast("double") / drawn)
        return F.when(at["to"] < shards, F.struct(at["to"].alias("b"), F.least(to, F.lit(1 << 40)).alias("to"))).otherwise(at)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["b"].cast("int")


def sharded(docs: DataFrame, shards: int = 40, overhead: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text and overhead; null has no bytes), text_crc32 (null: of nothing),
    law ("key"), shard, slot (gapless from 0 in each shard), grown_shard (with one more shard).

    Rows with equal keys share a shard and get different slots; a null key is a key like any other. The
    documents' own order does not matter; other columns are left out; long texts are only measured. An
    empty table gives no rows.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump(key, shards).alias("shard"),
        jump(key, shards + 1).alias("grown_shard"),
        # rows with one key in a third of the table still spread over the tasks that read them
        F.xxhash64(key, F.spark_partition_id()).alias("spread"),
    )
    rows = stored(rows, "sharded")
    buckets = max(1, -(-rows.count() // (shards * BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.pmod("spread", F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if shards * buckets <= MOST_SENT else starts
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("within", within).join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("within") - 1).alias("slot"), "grown_shard")
