from __future__ import annotations

from lumenkg.operators import terms
from lumenkg.sources import tables


def test_display(spark):
    rows = [("t", 1, None, 0, "plus"), ("t", 2, 1, 0, "x"), ("t", 3, 1, 1, "f"), ("t", 4, 3, 0, "y"), ("t", 5, 3, 1, "z"), ("u", 1, None, 0, "c")]
    own = spark.createDataFrame(rows, "owner string, node int, parent int, ord int, name string")
    found = terms.presented(own, spark.createDataFrame([("plus", "$1 + $2"), ("z", "ζ")], "name string, template string"))
    assert sorted((r.owner, r.text) for r in found.collect()) == [("t", "x + f(y, ζ)"), ("u", "c")]


def test_variables(spark):
    declared = spark.createDataFrame([("d", 1, 100, "a/x", "outer"), ("d", 10, 20, "x", "inner"), ("d", 30, 100, "b/x", "late")], "doc string, at int, upto int, name string, uri string")
    uses = spark.createDataFrame([("d", 15, "x"), ("d", 25, "x"), ("d", 40, "x"), ("d", 40, "a/x"), ("d", 40, "q")], "doc string, at int, name string")
    found = {(r[1], r[2]): r[3] for r in terms.resolved_variables(uses, declared).collect()}
    assert found == {(15, "x"): "inner", (25, "x"): "outer", (40, "x"): "late", (40, "a/x"): "outer", (40, "q"): None}


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    tables.save(a, path, "k")
    tables.save(spark.createDataFrame([("x", 9)], "k string, v int"), path, "k")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 9]
    assert sorted(map(tuple, tables.decoded(tables.encoded(a), "k string, v int").collect())) == [("x", 1), ("y", 2)]
    tables.clear(spark, path, "k string, v int")
    assert spark.read.schema("k string, v int").parquet(path).count() == 0
    answers = spark.createDataFrame([("http://x?a=b&m=m",), ("nonsense",)], "x string")
    assert [r.uri for r in tables.as_uris(answers).collect()] == ["http://x?a=b&m=m"]
    assert tables.as_uris(a).count() == 0


def test_json_lines(spark, tmp_path):
    spark.createDataFrame([("x", 1)], "k string, v int").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k string, v int").parquet(f"file://{tmp_path}/in")
    tables.json_lines(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.json(f"file://{tmp_path}/out").first().v == 1
