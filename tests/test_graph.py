from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenkg.operators import graph as G
from lumenkg.operators import history
from lumenkg.operators.closure import closure, levels


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4), (5, None), (1, 2)], "src int, dst int")
    assert pairs(closure(edges).select("src", "dst")) == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3), (4, 4)]
    seeds = spark.createDataFrame([(3,), (9,)], "src int")
    assert pairs(closure(edges, seeds, include_start=True).select("src", "dst")) == [(3, 2), (3, 3), (9, 9)]
    assert closure(edges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        closure(edges, most_rounds=1)


def test_levels(spark):
    tasks = spark.createDataFrame([(k,) for k in range(6)], "id int")
    deps = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 4), (4, 3), (5, 5), (5, 99)], "task int, dep int")
    assert pairs(levels(tasks, deps).select("id", F.coalesce("level", F.lit(-1)))) == [(0, 0), (1, 1), (2, 2), (3, -1), (4, -1), (5, -1)]


def test_patterns(spark):
    quads = spark.createDataFrame([("g", "a", "p", "a"), ("h", "a", "p", "a"), ("g", "a", "p", "b"), ("g", "b", "q", "c")], "g string, s string, p string, o string")
    t = G.triples(quads)
    assert t.count() == 3
    assert pairs(G.pattern(t, "?x", "p", "?x")) == [("a",)]
    assert pairs(G.bgp(t, ("?x", "p", "?y"), ("?y", "q", "?z")).select("x", "y", "z")) == [("a", "b", "c")]
    assert pairs(G.pattern(quads, "?x", "p", "a", "?g")) == [("a", "g"), ("a", "h")]


def test_minus_and_values(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "k string, v string")
    b = spark.createDataFrame([("1", None), ("9", "z")], "k string, v string")
    assert [r.k for r in G.minus(a, b).orderBy("k").collect()] == ["2", "3"]
    assert G.minus(a, b.select(F.col("k").alias("other"))).count() == 3
    got = G.values(a, spark.createDataFrame([(None, "z"), ("1", "x")], "k string, v string"))
    assert sorted(r.k for r in got.collect()) == ["1", "3"]
    left = G.optional(a, b.withColumn("n", F.lit(7)).drop("v"))
    assert sorted((r.k, r.n) for r in left.where("n is not null").collect()) == [("1", 7)]


def test_construct_drops_unbound(spark):
    a = spark.createDataFrame([("1", None), ("2", "y"), ("2", "y")], "k string, v string")
    assert pairs(G.construct(a, ("?k", "p", "?v"))) == [("2", "p", "y")]


def test_new_commits(spark):
    branches = spark.createDataFrame([("r", "main", 3, True), ("r", "ahead", 5, False), ("r", "behind", 2, False), ("r", "same", 3, False), ("r", "other", 99, False)], "repo string, name string, tip int, is_head boolean")
    parents = spark.createDataFrame([("r", 2, 1), ("r", 3, 2), ("r", 4, 3), ("r", 5, 4), ("r", 5, 2), ("r", 99, 98)], "repo string, id int, parent int")
    assert pairs(history.new_commits(branches, parents).select("name", "tip")) == [("ahead", 5)]


def test_upsert_keeps_admin(spark):
    schema = "id int, gitlab_id int, name string, is_admin boolean"
    users = spark.createDataFrame([(1, 10, "a", True)], schema)
    new = spark.createDataFrame([(7, 10, "b", False), (8, 11, "c", False)], schema)
    assert pairs(history.upserted(users, new)) == [(1, 10, "b", True), (8, 11, "c", False)]
