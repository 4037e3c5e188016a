"""Queries work on all of what they read, against brute force."""

from __future__ import annotations

from lumenkg.functions.uri import ESCAPES
from lumenkg.plans import own_queries
from lumenkg.plans.bridge import table

SF = "/root/testdata/sf0.001"


def test_whole_texts_are_escaped(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for c, code in ESCAPES.items():
        texts = {k: None if t is None else t.replace(c, code) for k, t in texts.items()}
    found = own_queries()["iri_escape"](spark, SF).collect()
    assert {r.doc_id: r.iri for r in found} == texts
    assert all(r.back for r in found if r.iri is not None)


def test_errors_of_all_pages(spark):
    docs = [r.doc for r in table(spark, SF, "elements").select("doc").distinct().collect()]
    found = {r.message: r.n for r in own_queries()["extract_errors"](spark, SF).collect()}
    assert found == {"unbalanced": len(docs), "unknown key: zzz": len(docs)}


def test_trees_of_all_documents(spark):
    plan = own_queries()["doc_var_notations"](spark, SF)
    assert "% 50" not in plan._jdf.queryExecution().toString() and plan.count() > 0
