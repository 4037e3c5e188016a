"""Rows of pages that are read once are those of marked() and rows(); what is asked of them needs no store and no second reading."""

from __future__ import annotations

import random

from test_marked_pages import PIECES

from lumenkg.operators import trees as T
from lumenkg.sources import html as H

WHOLE = '<div data-kg-section=""><b data-kg-title="">é</b>x</div>'
MORE = [*PIECES, WHOLE, WHOLE, WHOLE, '<div data-kg-module="m" data-kg-definition="" data-kg-id="d">', '<div data-kg-feature-structure="x/EXTSTRUCT1">', '<i data-kg-import="a">', "</i>", '<h1 data-kg-doctitle="">', "</h1>", "!-- ", "<!-->", "<!--", "<SCRIPT>", "script>"]


def _pages(spark):
    rng = random.Random(5)
    pages = [None, "", "!-- <p data-kg-id=''>", "!-- --><p data-kg-title=''>é</p>", "script><p data-kg-title=''></script><p data-kg-title=''>"]
    pages += ["".join(rng.choice(MORE) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    return spark.createDataFrame(list(enumerate(pages)), "doc int, html string").repartition(3)


def _key(df):
    return sorted(map(repr, df.collect()))


def test_same_as_rows(spark):
    df = _pages(spark)
    want = H.rows(H.annotated(H.nodes(H.tags(df))))
    got = H.page_rows(df)
    assert got.columns == [*want.columns, "title"]
    assert _key(got.drop("title")) == _key(want) and want.count() > 500
    some = [*H.CONTAINERS, "title"]
    assert _key(H.page_rows(df, kinds=some).drop("title")) == _key(want.where(want.kind.isin(some)))


def test_same_elements(spark):
    df = _pages(spark)
    want = H.elements(H.rows(H.annotated(H.nodes(H.tags(df)))))
    got = H.elements(H.page_rows(df)).withColumn("title", H.F.when(H.F.col("title").isNotNull(), H.F.struct("title.start", "title.stop")))
    assert got.columns == want.columns and _key(got) == _key(want)
    assert got.where("title is not null").count() > 50


def test_nothing_is_dealt_or_stored(spark, monkeypatch):
    monkeypatch.setattr(H, "stored", None)
    plan = H.elements(H.page_rows(spark.createDataFrame([(1, "<p>")], "doc int, html string")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_same_errors(spark):
    df = _pages(spark)
    want = H.errors(H.nodes(H.tags(df)))
    assert _key(H.page_errors(df)) == _key(want) == _key(H.errors(H.marked(df))) and want.count() > 300
    assert "Exchange" not in H.page_errors(spark.createDataFrame([(1, "<p>")], "doc int, html string"))._jdf.queryExecution().executedPlan().toString()
    assert H.errors(H.marked(df))._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_same_titles(spark):
    df = _pages(spark).withColumn("doc", H.F.concat(H.F.lit("d"), "doc"))
    own = H.rows(H.marked(df), dealt=True)
    heads = own.where("kind = 'doctitle'").select("doc", H.F.col("inner_start").alias("start"), H.F.col("inner_stop").alias("stop"))
    want = T.titles(H.elements(own), heads, df)
    got = T.page_titles(df)
    assert _key(got) == _key(want) and got.where("title != ''").count() > 50
    texts = H.elements(H.page_rows(df, kinds=H.CONTAINERS, texts=True, keys=())).where("title.text = 'é'")
    assert texts.count() > 50 and texts.where("cardinality(attrs) > 0").isEmpty()
