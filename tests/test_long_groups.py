"""Groups with many rows are never held as one array; loops end with a result or an error."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenkg.operators import logs as G
from lumenkg.plans import own_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_moving_averages(spark, block):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("key"), F.when(F.col("id") != 100, F.col("id") * 37 % 101).cast("double").alias("value"))
    whole = rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]).alias("vs"))
    want = {r.key: r.a for r in whole.select("key", G.moving_average(F.col("vs")).alias("a")).collect()}
    assert {r.key: r.average for r in G.moving_averages(rows, "key", "id", "value", block=block).collect()} == pytest.approx(want)


def test_messages_are_not_collected(spark):
    plan = own_queries()["log_span_durations"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
