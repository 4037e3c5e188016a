"""Counters, subtraction of ranges, and terms against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lumenkg.operators import counters as C
from lumenkg.operators import formulas as T
from lumenkg.operators import problems as P
from lumenkg.sources import html as H


def rows_of(spark, pages: dict):
    df = spark.createDataFrame(list(pages.items()), "doc string, html string").repartition(2)
    return df, H.rows(H.annotated(H.nodes(H.tags(df))))


def test_running_numbers_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, n * 3 + rng.randrange(3), rng.random() < 0.6, rng.random() < p) for k, p in (("a", 0.02), (None, 0.3), ("c", 0.0)) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, at long, adds boolean, resets boolean").repartition(3)
    want, state = {}, {}
    for k, at, adds, resets in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        state[k] = (0 if resets else state.get(k, 0)) + adds
        want[k, at] = state[k]
    for block in (1, 7, 4096):
        got = C.running(df, ("k",), "at", F.col("adds"), F.col("resets"), block=block)
        assert {(r.k, r["at"]): r.number for r in got.collect()} == want


def test_counters_that_are_declared_twice_or_not_at_all(spark):
    page = (
        '<i data-kg-style="definition" data-kg-counter="a"></i><i data-kg-style="definition" data-kg-counter="b"></i><i data-kg-style="example-x" data-kg-counter="b"></i><i data-kg-counter-parent="9" data-kg-counter="b"></i><i data-kg-counter-parent="1"></i>'
        '<p data-kg-definition=""></p><section data-kg-section="9"></section><p data-kg-example="" data-kg-styles="y, x"></p><p data-kg-example="" data-kg-styles="y"></p><section data-kg-section="12"></section><p data-kg-definition=""></p><section data-kg-section="3"></section><p data-kg-definition=""></p><section data-kg-section="no"></section>'
    )
    _, rows = rows_of(spark, {"d": page, "empty": ""})
    split = F.filter(F.transform(F.split(F.coalesce(F.col("attrs")["styles"], F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    own = rows.where(F.col("kind").isin(*H.CONTAINERS)).select("doc", F.col("nth").alias("node"), "kind", F.col("attrs")["section"].try_cast("int").alias("level"), split.alias("styles"))
    got = [(r.counter, r.number, r.label) for r in C.numbers(own, C.styles(rows), C.parents(rows)).orderBy("node").collect()]
    assert got == [("b", 1, "1"), ("section 9", 1, "1"), ("b", 1, "1.1"), ("section 12", 1, "1.1"), ("b", 2, "1.2"), ("section 3", 1, "1"), ("b", 1, "1.1")]


def plain_stripped(raw: bytes, start: int, stop: int, cut: list[tuple[int, int]]) -> str:
    """Without the bytes of ranges strictly within."""
    gone = {k for a, b in cut if start <= a and b <= stop and (a, b) != (start, stop) for k in range(a, b)}
    return bytes(raw[k] for k in range(start, stop) if k not in gone).decode()


def test_nested_ranges_are_cut_out(spark):
    rng = random.Random(3)
    pages, holes, ranges = {}, [], []

    def grow(doc: str, a: int, b: int, level: int) -> None:
        at = a
        while at + 4 < b and rng.random() < 0.8:
            x = rng.randrange(at, b - 3)
            y = rng.randrange(x + 2, b)
            ranges.append((doc, len(ranges), x, y))
            if rng.random() < 0.6:
                holes.append((doc, len(ranges), x, y, level))
                grow(doc, x + 1, y - 1, level + 1)
            at = y + 1

    for d in range(6):
        pages[f"d{d}"] = "".join(rng.choice("abcdefgh") for _ in range(120))
        grow(f"d{d}", 0, 120, 1)
        ranges.append((f"d{d}", len(ranges), 0, 120))
    pages["none"] = "x"
    cut = spark.createDataFrame(holes, "doc string, nth int, start long, stop long, level int").repartition(3)
    own = spark.createDataFrame(ranges, "doc string, nth int, start long, stop long").repartition(3)
    html = spark.createDataFrame(list(pages.items()), "doc string, html string")
    got = {r.nth: r.text for r in P.stripped(own, cut, html).collect()}
    assert len(got) == len(ranges) > 20
    for doc, nth, a, b in ranges:
        assert got[nth] == plain_stripped(pages[doc].encode(), a, b, [h[2:4] for h in holes if h[0] == doc]), (doc, a, b)


def test_problem_without_parts_and_parts_without_problem(spark):
    pages = {"d": '<div data-kg-problem="">é</div><p data-kg-solution="">lost</p>', "n": '<div data-kg-problem=""><p data-kg-solution="" data-kg-answerclass="">a<div data-kg-subproblem=""><p data-kg-solution="" data-kg-answerclass="k">b</p></div>c</p></div>'}
    df, rows = rows_of(spark, pages)
    assert sorted((r.doc, r.text) for r in P.texts(rows, df).collect())[0] == ("d", '<div data-kg-problem="">é</div>')
    got = sorted(((r.part, r["name"], r.html) for r in P.parts(rows, df).collect()), key=str)
    assert got == [("solution", "k", "b"), ("solution", None, 'a<div data-kg-subproblem=""><p data-kg-solution="" data-kg-answerclass="k"></p></div>c')]


def term(kind, head, *args):
    return f'<a data-kg-term="{kind}" data-kg-head="{head}">' + "".join(f'<b data-kg-arg="{n}" data-kg-argmode="{m}">{x}</b>' for n, m, x in args) + "</a>"


def test_terms_and_brackets(spark):
    v = lambda n: term("OMV", n)
    plus = lambda *xs: term("OMA", "m?plus", *[(f"1{k + 1}", "a", x) for k, x in enumerate(xs)])
    pages = {
        "nested": plus(term("OMA", "m?neg", ("1", "i", plus(v("a"), v("b")))), v("c"), term("OMA", "m?neg", ("1", "i", v("d")))),
        "direct": '<a data-kg-term="OMA" data-kg-head="m?neg"><i data-kg-term="OMV" data-kg-head="q" data-kg-arg="1" data-kg-argmode="i"></i></a>',
        "bare": '<a data-kg-term="OMA" data-kg-head="m?none"><i data-kg-arg="2" data-kg-argmode="i">text</i><i data-kg-arg="1" data-kg-argmode="i"></i></a>',
        "leaf": term("OMID", "http://x?m?zero"), "dollar": term("OMA", "m?cost", ("1", "i", v("x"))), "nothing": "<p>no term</p>",
        "bound": term("OMBIND", "m?all", ("1", "b", v("x")), ("2", "i", plus(v("x"), v("y")))) + v("x"),
    }
    _, rows = rows_of(spark, pages)
    found = T.terms(rows)
    notations = spark.createDataFrame([("m?plus", "${1 + }", 20, [20]), ("m?neg", "-$1", 5, [5]), ("m?zero", "0", 0, []), ("http://x?m?zero", "0", 0, []), ("m?cost", "$ $1 $", 0, None), ("m?plus", "${1 + }", 20, [20])], "name string, template string, precedence long, argprecs array<long>").limit(5)
    got = {r.doc: r.text for r in T.written(found, notations).where("parent is null").collect() if r.doc != "bound"}
    assert got == {"nested": "-(a + b) + c + -d", "direct": "-q", "bare": "none(?,?)", "leaf": "0", "dollar": "$ x $"}
    assert sorted((r.doc, r["name"]) for r in T.free_variables(found.where("doc = 'bound'")).collect()) == [("bound", "x"), ("bound", "y")]


def test_components_of_a_notation(spark):
    page = '<p data-kg-notation="m?plus"><span data-kg-notationcomp=""><b data-kg-comp="">(</b><i data-kg-arg="1" data-kg-argmode="a">x<u data-kg-argsep=""><b data-kg-comp="">+</b></u></i><b data-kg-maincomp="">)</b></span></p>'
    df, rows = rows_of(spark, {"d": page})
    got = [(r.kind, r.number, r.text) for r in T.components(rows, df).orderBy("nth").collect()]
    assert got == [("comp", None, "("), ("arg", "1", None), ("argsep", None, None), ("comp", None, "+"), ("maincomp", None, ")")]
