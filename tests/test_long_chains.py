"""Loops end with a whole result or an error."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenkg.operators.closure import levels
from lumenkg.operators.trees import contents, paths
from lumenkg.sources import html as H


def test_chains_that_are_too_long(spark):
    tasks = spark.range(5)
    deps = spark.range(1, 5).select(F.col("id").alias("task"), (F.col("id") - 1).alias("dep"))
    assert {r.id: r.level for r in levels(tasks, deps, 5).collect()} == {k: k for k in range(5)}
    with pytest.raises(ValueError):
        levels(tasks, deps, 3)
    nodes = spark.range(5).select(F.lit("d").alias("doc"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("ord"))
    assert paths(nodes, 4).count() == 5
    with pytest.raises(ValueError):
        paths(nodes, 3)
    inputs = spark.createDataFrame([(f"d{k}", 1, [1], "inputref", None, f"d{k + 1}") for k in range(4)], "doc string, node int, path array<int>, kind string, title string, target string")
    with pytest.raises(ValueError):
        contents(inputs, inputs, spark.createDataFrame([("d0",)], "root string"), 2)
    page = '<div data-kg-section="">' * 5 + "</div>" * 5
    own = H.rows(H.annotated(H.nodes(H.tags(spark.createDataFrame([("d", page)], "doc string, html string")))))
    assert H.elements(own).count() == 5
    with pytest.raises(ValueError):
        H.elements(own, 3)
