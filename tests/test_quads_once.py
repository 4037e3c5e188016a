"""The quads that are made by one reading of each table are those of their SQL."""

from __future__ import annotations

import pytest

from lumenkg.plans.bridge import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("wanted", ["", "type", "requires", "contains,hasPart,type,crossrefs,defines", "extends,part-of,po-symbol"])
def test_same_rows(spark, wanted):
    every = table(spark, SF, "quads")
    want = every.where(every.p.isin(wanted.split(","))) if wanted else every
    got = table(spark, SF, f"quads:{wanted}")
    assert got.schema.names == ["g", "s", "p", "o"]
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") <= 1


def test_line_items_are_dealt_once(spark):
    """What a document requires, once for each supplier, is found where the elements of the document were numbered."""
    plan = table(spark, SF, "quads:requires")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rows_that_say_nothing_go_first(spark):
    plan = table(spark, SF, "quads:objective,po-symbol")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("Generate"):].split("Window")[0]
