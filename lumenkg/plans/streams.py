"""The log queries as streams that read what is there and end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir
from ..streaming import logs as S
from . import editing
from .bridge import TABLES
from .registry import Queries

Q = Queries()


def streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str, files: int = 64) -> DataFrame:
    """The result of a stream over the events, as a table. Each batch of a complete result writes over the one before.

    files: how many a batch reads. An appended result comes in two runs of one query: when all events are read,
    a last line far in the future moves the watermark past all of them.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as the source of files takes a single file for a folder
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/event[s].parquet")
    lines = spark.sql(TABLES["log_lines"], events=events)
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def run(df: DataFrame) -> None:
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", f"{place}/rows").start()
        else:
            query = writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{place}/rows")).start()
        query.awaitTermination()

    if mode != "append":
        out = build(lines)
        run(out)
        return spark.read.schema(out.schema).parquet(f"{place}/rows")
    ends = spark.createDataFrame([], lines.schema)
    ends.write.parquet(f"{place}/ends")
    out = build(lines.unionByName(spark.readStream.schema(lines.schema).parquet(f"{place}/ends")))
    before = spark.conf.get(S.STATE_STORE[0])
    spark.conf.set(*S.STATE_STORE)
    try:
        run(out)
        end = spark.range(1).select("*", F.lit("message").alias("tag"), F.lit(-1).alias("span"), F.timestamp_seconds(F.lit(1 << 36)).alias("ts"))
        end.select(*[(F.col(f.name) if f.name in end.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in lines.schema]).write.mode("append").parquet(f"{place}/ends")
        run(out)
    finally:
        spark.conf.set(S.STATE_STORE[0], before)
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


def _spans(spark: SparkSession, sf_dir: str, files: int = 64) -> DataFrame:
    """Files of a table at rest come in any order, so events may be as late as the table is long."""
    long_ = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.coalesce(F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp")), F.lit(0)) + 1).first()[0]
    out = streamed(spark, sf_dir, lambda lines: S.span_durations(lines, late=f"{long_} seconds"), "append", files)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened", "closed")})


Q.queries["stream_level_counts"] = lambda spark, sf_dir: streamed(spark, sf_dir, S.level_counts, "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
Q.sql["stream_level_counts"] = editing.Q.sql["log_level_counts"]
Q.queries["stream_span_durations"] = _spans
Q.sql["stream_span_durations"] = f"SELECT span, opened, closed, messages FROM ({editing.Q.sql['log_span_durations']}) s WHERE closed IS NOT NULL"
