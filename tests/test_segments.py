"""An index that grew gives what a new one gives; texts of pages against a plain reading."""

from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from lumenkg.functions.text import ENDS, html_to_text
from lumenkg.operators import search as S
from lumenkg.operators.segments import Segments

SCHEMA = "uri string, title string, body string, kind int, def_like boolean, fors array<string>"
ROWS = [(f"u{n}", f"title {n % 3}", " ".join(["alpha"] * (n % 4) + ["beta"] * (n % 3) + ["gamma"]), n % 6, n % 2 == 0, ["s"]) for n in range(30)]


def found(index, query="alpha beta", **options):
    return [(r.uri, round(r.score, 9)) for r in S.search(index, query, every=False, **options).collect()]


def test_grown_as_new(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    own = Segments(spark, f"file://{tmp_path}/index")
    assert found(own.open()) == [] and own.compact().number == 0
    own.add(frame(ROWS[:10]))
    own.add(frame(ROWS[10:20]))
    own.add(frame([(*r[:2], "delta beta beta", *r[3:]) for r in ROWS[5:15]]))
    own.delete(frame(ROWS[::4]).select("uri").union(spark.createDataFrame([("none",)], "uri string")))
    at = own.add(frame(ROWS[20:]))
    assert at.number == 5 and len(at.segments) == 4
    want = {r[0]: r for r in ROWS[:20]} | {r[0]: (*r[:2], "delta beta beta", *r[3:]) for r in ROWS[5:15]}
    for r in ROWS[::4]:
        want.pop(r[0], None)
    want |= {r[0]: r for r in ROWS[20:]}
    new = S.index(frame(list(want.values())), keep=False)
    for query in ("alpha beta", "delta", "gamma title"):
        assert found(own.open(), query) == found(new, query)
    assert found(own.open(), kinds=(1, 2), definition_like=True) == found(new, kinds=(1, 2), definition_like=True)
    old = found(own.open(1))
    small = own.compact()
    assert len(small.segments) == 1 and not small.tombstones and found(own.open()) == found(new) and found(own.open(1)) == old
    assert {(f, n, s) for f, n, s in small.sums} == {(r.field, r.n, r.s) for r in new.lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("s")).collect()}
    assert own.vacuum() > 3 and found(own.open()) == found(new)


def test_one_of_two_writers(spark, tmp_path):
    own = Segments(spark, f"file://{tmp_path}/index")
    first = own.add(spark.createDataFrame(ROWS[:3], SCHEMA))
    with pytest.raises(RuntimeError):
        own._commit(first)
    assert own.version().number == 1


def plain_text(page: str) -> str:
    page = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "", page)
    out = []
    for part in re.split(r"(<[^>]*>)", re.sub(r"[ \t\n\x0b\f\r]+", " ", page)):
        if part.startswith("<") and part.endswith(">"):
            out.append("\n" if re.match(r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/title|/article|/section)\b", part) else "")
        else:
            out.append(part)
    lines = re.sub(r" *\n *", "\n", html.unescape("".join(out).replace("&nbsp;", " "))).strip(" ")
    kept, k = [], 0
    while k < len(lines):
        if lines[k] == "\n" and k + 1 < len(lines) and not (k and lines[k - 1] in ENDS):
            k += 1
            continue
        kept.append(lines[k])
        if lines[k] == "\n" and k + 1 < len(lines) and lines[k + 1] == "\n" and k and lines[k - 1] in ENDS:
            kept.append("\n")
            k += 1
        k += 1
    return "".join(kept)


def test_text_of_pages(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html", html_to_text(F.col("html")).alias("text")).collect()
    known = ("lt", "gt", "quot", "#39", "nbsp", "amp")
    for r in own:
        if all(e in known for e in re.findall(r"&(#?\w+);", r.html)):
            assert r.text == plain_text(r.html), r.page_id
