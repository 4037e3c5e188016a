"""Session settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of a batch that goes to a Python worker: long texts must not fill its memory.
BATCH_BYTES = "4m"


def session(app: str = "lumenkg", master: str | None = None, **settings: str) -> SparkSession:
    """A session as the queries expect it: UTC, adaptive execution, Arrow. settings: further ones, dots written as __."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find the package where it lies on the same path for them as for the driver, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark
