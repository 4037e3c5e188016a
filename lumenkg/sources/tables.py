"""Results as tables and lines: builds, logs, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uri import parse


def save(df: DataFrame, path: str, *keys: str) -> None:
    """Write over the partitions (by keys) that df has rows of; the others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)


def clear(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table in place of the one that was there."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def as_uris(solutions: DataFrame) -> DataFrame:
    """Of answers with one column: those that are identifiers, parsed. Other answers are left out, as are all answers with more columns."""
    if len(solutions.columns) != 1:
        return solutions.limit(0).select(F.lit(None).cast("string").alias("uri"), parse(F.lit(None).cast("string")).alias("parts"))
    (name,) = solutions.columns
    return solutions.select(F.col(name).alias("uri"), parse(F.col(name)).alias("parts")).where("parts.kind is not null")


def encoded(df: DataFrame) -> DataFrame:
    """Each row as hexadecimal digits of its JSON."""
    return df.select(F.hex(F.to_json(F.struct(*df.columns))).alias("code"))


def decoded(codes: DataFrame, schema: str) -> DataFrame:
    return codes.select(F.from_json(F.decode(F.unhex("code"), "UTF-8"), schema).alias("x")).select("x.*")


def json_lines(stream: DataFrame, path: str, checkpoint: str):
    """A streaming sink of one JSON object a line."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
