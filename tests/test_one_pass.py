"""Steps that read or sort their rows once: nesting, triples, numbers; and keys above a million."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lumenkg.operators import trees
from lumenkg.plans import documents
from lumenkg.sources import html as H
from lumenkg.sources.ranges import around


def _plan(df, what):
    return df._jdf.queryExecution().executedPlan().toString().count(what)


def test_triples_read_rows_a_few_times(spark):
    page = '<div data-kg-module="m"><i data-kg-import="a"></i><div data-kg-feature-structure="x/EXTSTRUCT1"><i data-kg-import="b"></i></div></div>'
    own = H.rows(H.annotated(H.nodes(H.tags(spark.createDataFrame([("d", page)], "doc string, html string")))))
    found = H.triples(own, H.elements(own))
    assert _plan(found, "FileScan") <= 5
    assert {tuple(r)[1:] for r in found.collect()} >= {("d&e=module", "imports", "a"), ("d&e=module/structure", "imports", "b"), ("d&e=module/structure", "extends", "b")}


def test_around_is_the_innermost_range(spark):
    rng, rows = random.Random(3), []

    def grow(doc, a, b):
        while a + 2 < b:
            x = rng.randrange(a, b - 1)
            y = rng.randrange(x + 1, b)
            rows.append((doc, x, rng.choice("pqr"), x, y if rng.random() < 0.9 else None))
            grow(doc, x + 1, y)
            a = y + 1

    for d in range(5):
        grow(f"d{d}", 0, 60)
    df = spark.createDataFrame(rows, "doc string, nth int, kind string, start long, stop long").repartition(3)
    got = {(r.doc, r.nth): (r.one, r.two) for r in around(df, {"one": ("p",), "two": ("q", "r")}).collect()}
    for doc, nth, _, start, _ in rows:
        inner = lambda kinds: max((r[1] for r in rows if r[0] == doc and r[2] in kinds and r[4] is not None and r[3] < start < r[4]), default=None)  # noqa: B023, E731
        assert got[doc, nth] == (inner("p"), inner("qr"))


def test_numbers_sort_once(spark):
    df = spark.createDataFrame([("d", n, level) for n, level in enumerate([0, 1, 2, 2, 1, 2, None, 0, 2, 1])], "doc string, ord int, level int")
    found = trees.section_numbers(df)
    assert _plan(found, "Sort [") == 1
    assert [r.label for r in found.orderBy("ord").collect()] == ["1", "1.1", "1.1.1", "1.1.2", "1.2", "1.2.1", None, "2", "2.2.1", "2.3"]
    run = trees.counters(df, F.col("level") == 2, F.col("level") == 1)
    assert _plan(run, "Sort [") == 1
    assert [r.number for r in run.orderBy("ord").collect()] == [None, None, 1, 2, None, 1, None, None, 2, None]


def test_links_out_of_all_symbols_stay_unresolved(spark):
    e = spark.createDataFrame([("a", 2, 5), ("b", 2, 5), ("c", 1, 5), ("d", 3, 1_000_005)], "uri string, level int, part long")
    p = spark.createDataFrame([(5,), (1_000_005,)], "p_partkey long")
    assert [tuple(r) for r in documents._unresolved(e, p).collect()] == [("sym/1000005", 2)]
