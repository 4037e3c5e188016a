"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; when a task ends, free memory goes back to the system. The Python worker lives on beside those of other stages."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


_own = threading.local()


def made() -> list[str]:
    """Paths of the tables that this thread has stored and not dropped, in their order."""
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: later jobs, and tasks that run again after an executor is lost, read the
    table instead of computing it anew.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables stored since made() had mark entries, but for those that the frames of keep read."""
    files = [f for df in keep for f in df.inputFiles()]
    names = {f.split("/")[-2] for f in files}
    gone = [p for p in made()[mark:] if p.split("/")[-1] not in names]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        made().remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a filter. It has at most BITS / 64 rows, 4 MB, whatever it is made from.
BITS = 1 << 23


def bit_filter(df: DataFrame, key: Column) -> DataFrame:
    """A set of keys (longs) as bits: rows (word, bits), at most BITS / 64 of them."""
    at = F.pmod(key, F.lit(BITS))
    return df.select((at / 64).cast("int").alias("word"), F.pmod(at, F.lit(64)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def flagged(df: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: false only where the key is not in the set of the filter, which is small enough to broadcast."""
    at = F.pmod(key, F.lit(BITS))
    own = bits.select(F.col("word").alias(f"{name}_word"), F.col("bits").alias(f"{name}_bits"))
    met = df.withColumn(f"{name}_at", at).join(F.broadcast(own), (F.col(f"{name}_at") / 64).cast("int") == F.col(f"{name}_word"), "left")
    hit = F.coalesce(F.expr(f"getbit({name}_bits, cast({name}_at % 64 as int))") == 1, F.lit(False))
    return met.withColumn(name, hit).drop(f"{name}_word", f"{name}_bits", f"{name}_at")
