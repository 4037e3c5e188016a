"""The stored graph: kinds of terms apart, order of joins, parts that are read, graphs in place of others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenkg.functions import terms as T
from lumenkg.operators import store as S

COLUMNS = "g string, s string, p string, o string, o_kind string, o_lang string, o_dtype string"
ROWS = [("g1", f"a{n}", "likes", f"a{n % 7}", None, None, None) for n in range(70)] + [
    ("g2", "a1", "likes", "a1", None, None, None), ("g1", "a1", "name", "x", "literal", "EN", None), ("g1", "a1", "name", "x", "literal", None, None), ("g1", "a1", "name", "x", None, None, None),
    ("g1", "a2", "age", "07", "literal", None, f"{T.XSD}integer"), ("g1", "a3", "age", "7", "literal", None, f"{T.XSD}integer"), ("g1", "a4", "age", "no", "literal", None, f"{T.XSD}integer"), ("g2", "_:b", "name", "x", "literal", "en", None), ("g1", None, "likes", "a1", None, None, None),
]


@pytest.fixture(scope="module")
def store(spark):
    return S.build(S.quads_of(spark.createDataFrame(ROWS, COLUMNS)))


def test_terms_of_different_kinds_are_apart(store):
    own = S.resolved(store, S.match(store, "?s", "name", "?o"))
    got = sorted((r.s.kind, r.o.kind, r.o.lang or "", r.o.value) for r in own.collect())
    assert got == [("bnode", "literal", "en", "x"), ("iri", "iri", "", "x"), ("iri", "literal", "", "x"), ("iri", "literal", "en", "x")]
    assert S.match(store, "?s", "name", T.literal(F.lit("x"), F.lit("en"))).count() == 2
    assert S.match(store, "_:b", "name", "?o").count() == 1


def test_a_triple_in_two_graphs_counts_once(store):
    assert S.match(store, "a1", "likes", "?o").count() == 1
    assert S.match(store, "a1", "likes", "?o", "?g").count() == 2
    assert S.match(store, "?x", "likes", "?x").count() == 7


def test_numbers_compare_by_value(spark, store):
    own = S.resolved(store, S.match(store, "?s", "age", "?o"))
    seven = T.literal(F.lit("7.0"), None, F.lit(f"{T.XSD}double"))
    assert sorted(r.s.value for r in own.where(T.same(F.col("o"), seven)).collect()) == ["a2", "a3"]
    assert own.where(T.is_numeric(F.col("o"))).count() == 2
    assert own.where(T.less(F.col("o"), T.literal(F.lit("8"), None, F.lit(f"{T.XSD}integer")))).count() == 2
    assert [r[0] for r in spark.range(1).select(T.after(F.lit("ab/c"), "/")).collect()] == ["c"] and [r[0] for r in spark.range(1).select(T.before(F.lit("abc"), "/")).collect()] == [""]


def test_the_smallest_pattern_comes_first(store):
    assert S.order(store, ("?x", "likes", "?y"), ("?y", "age", "?n"), ("?z", None, "?w")) == [1, 0, 2]
    assert S.order(store, ("?x", "likes", "?y"), ("?y", "none", "?n")) == [1, 0]
    assert S.bgp(store, ("?x", "likes", "?y"), ("?y", "age", "?n")).count() == 30


def test_a_pattern_reads_the_part_of_its_predicate(store):
    plan = S.match(store, "?x", "likes", "a3")._jdf.queryExecution().toString()
    scan = plan.split("== Physical Plan ==")[1]
    assert "(p#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(o," in scan and "EqualTo(default,true)" in scan


def test_graphs_are_replaced_and_cleared(spark, store):
    new = S.quads_of(spark.createDataFrame([("g1", "z", "likes", "z", None, None, None)], COLUMNS))
    again = S.replaced(store, new)
    assert S.match(again, "?s", "likes", "?o").count() == 2 and S.match(store, "?s", "likes", "?o").count() == 70
    assert S.match(S.cleared(again, "g2"), "?s", None, "?o").count() == 1


def test_nothing_stored(spark):
    empty = S.build(S.quads_of(spark.createDataFrame([], COLUMNS)))
    assert empty.names.count() == 0 and S.bgp(empty, ("?x", "p", "?y"), ("?y", "p", "?z")).count() == 0
