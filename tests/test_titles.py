"""Titles of documents and elements, where there are none, and where ranges are odd."""

from __future__ import annotations

from lumenkg.operators import trees as T

ELEMENTS, HEADS = "doc string, kind string, uri string, title struct<start:long,stop:long>", "doc string, start long, stop long"


def test_titles(spark):
    pages = spark.createDataFrame([("a", "<b>é</b>xyz", 1), ("b", None, 2), ("c", "", 3)], "doc string, html string, uri int")
    elements = spark.createDataFrame(
        [("a", "section", "a/s", (3, 5)), ("a", "slide", "a/l", (3, 5)), ("a", "problem", "a/p", None), ("a", "example", "a/e", (9, 400)), ("a", "proof", "a/q", (5, 3)), ("b", "section", "b/s", (0, 4)), ("gone", "section", "g/s", (0, 1))], ELEMENTS
    )
    heads = spark.createDataFrame([("a", 10, 12), ("a", 0, 9), ("a", None, 3), ("b", 0, 2)], HEADS)
    want = {"a": "<b>é</b>", "a/s": "é", "a/p": "", "a/e": "xyz", "a/q": "", "b": "", "b/s": "", "c": ""}
    got = T.titles(elements, heads, pages).collect()
    assert {r.uri: r.title for r in got} == want and len(got) == len(want)


def test_nothing(spark):
    assert T.titles(spark.createDataFrame([], ELEMENTS), spark.createDataFrame([], HEADS), spark.createDataFrame([], "doc string, html string")).count() == 0
