"""What documents reference and define goes up together."""

from __future__ import annotations

from lumenkg.operators import graph as G

Q = [("a", "type", "document"), ("b", "type", "document"), ("c", "type", "document"), ("a", "hasPart", "b"), ("b", "hasPart", "c"), ("a", "contains", "a/1"), ("a/1", "contains", "a/1/x"), ("b", "contains", "b/1"), ("c", "contains", "c/1")]
Q += [("a/1/x", "crossrefs", "s"), ("a/1", "defines", "t"), ("b/1", "crossrefs", "t"), ("b", "crossrefs", "d"), ("c/1", "defines", "s"), ("c/1", "crossrefs", "cs"), ("c/1", "crossrefs", "s"), ("c", "crossrefs", "x"), ("c", "defines", "ds"), ("lone", "crossrefs", "s")]


def test_intent(spark):
    quads = spark.createDataFrame(Q, "s string, p string, o string")
    got = sorted(map(tuple, G.prerequisites(quads, True).collect()))
    want = sorted(map(tuple, G.bound_minus(G.symbols_of(quads, "crossrefs"), G.symbols_of(quads, "defines")).collect()))
    assert got == want == [("a", "cs"), ("a", "d"), ("a", "x"), ("b", "cs"), ("b", "d"), ("b", "t"), ("b", "x"), ("c", "cs"), ("c", "x")]


def test_goes_up_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(G, "documents", lambda q, own=G.documents: (asked.append(1), own(q))[1])
    found = G.prerequisites(spark.createDataFrame(Q, "s string, p string, o string"), True)
    assert len(asked) == 1 and "left_anti" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftanti", "left_anti")
