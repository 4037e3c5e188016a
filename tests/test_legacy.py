"""Identifiers of an older form: every form, unknown places, and ties."""

from __future__ import annotations

from lumenkg.operators.legacy import converted

WANT = {
    "http://old.org/a/b/x/y?mod?sym": "http://new.org?a=a/b&p=x/y&m=mod&s=sym",
    "http://old.org/a/b?mod-module?sym": "http://new.org?a=a/b&m=mod&s=sym",
    "http://old.org/a/b/x/?mod-module": "http://new.org?a=a/b&p=x&m=mod",
    "http://new.org/a/b/x?mod": "http://new.org?a=a/b&p=x&m=mod",
    "http://old.org/a/b/x/doc.de.tex": "http://new.org?a=a/b&p=x&d=doc&l=de",
    "http://old.org/a/b/doc": "http://new.org?a=a/b&d=doc&l=en",
    "http://old.org/a/b/doc.zz.tex": "http://new.org?a=a/b&d=doc.zz&l=en",
    "http://old.org/a/b/x?mod?[http://old.org/c?str-module]/name": "http://new.org?a=a/b&p=x&m=mod&s=str/name",
    "http://old.org/a/bx?mod?sym": None,
    "http://old.org/a/b/x?mod?[http://old.org/zz?str]/name": None,
    "http://old.org/c/d/e?m": "http://new.org?a=c&p=d/e&m=m",
    "http://meta.org/all/x?m?s": "http://m.org?a=meta&p=x&m=m&s=s",
    "http://else.org/a/b?m": None,
    "file:///home/x/doc.tex": "http://none.org?a=no/archive&p=home/x&d=doc&l=en",
    "http://old.org/a/b?m?": None,
    "nothing": None,
    "": None,
}


def test_forms(spark):
    uris = spark.createDataFrame([(u, 1) for u in [*WANT, "nothing", None]], "uri string, id int")
    archives = spark.createDataFrame([("http://new.org", "a/b", 1), ("http://new.org", "c", 1), ("http://new.org", "c/d", 1), ("http://new.org", "c", 2), (None, "q", 1)], "base string, id string, uri int")
    fixed = (("http://meta.org/all", "http://m.org", "meta"), ("file:", "http://none.org", "no/archive"))
    got = converted(uris, archives, ("http://old.org/",), fixed).collect()
    assert {r.uri: r.id for r in got} == WANT and len(got) == len(WANT)


def test_nothing(spark):
    assert converted(spark.createDataFrame([], "uri string"), spark.createDataFrame([], "base string, id string")).count() == 0
    assert converted(spark.createDataFrame([("a/b?c",)], "uri string"), spark.createDataFrame([], "base string, id string"), ("x",)).first().id is None
