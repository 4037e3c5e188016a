"""Annotated elements that are found in one reading of a page are those of tags and nodes."""

from __future__ import annotations

import random

from lumenkg.sources import html as H

PIECES = ['<div data-kg-section="">', "</div>", "<p>", "</p>", '<br data-kg-id="é">', "</br>", "<b DATA-KG-term='x>y'/>", "<!-- <b data-kg-id='n'>", "-->", "<script>", "</script >", "<style ", "</style>", "é", "a < b", "</span>", '<span data-kg-title="">', '<a data-kg-x="', ">", "<1>", "<i data-kg-id='&amp;lt; \"' data-kg-id=2 data-kg-comp>"]


def test_same_as_tags_and_nodes(spark):
    rng = random.Random(3)
    pages = [None, "", "<", '<p data-kg-id="x">'] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(pages)), "doc int, html string").repartition(3)
    want = H.annotated(H.nodes(H.tags(df)))
    got = H.marked(df)
    assert got.columns == want.columns
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(want) and len(key(got)) > 500
    assert key(H.rows(got, dealt=True)) == key(H.rows(want))


def test_nothing_is_dealt(spark):
    df = spark.createDataFrame([(1, "<p>")], "doc int, html string")
    assert "Exchange" not in H.marked(df)._jdf.queryExecution().executedPlan().toString()
