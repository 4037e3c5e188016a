"""Terms of pages made of the derived elements: their text, their symbols, and variables that are free."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formulas as T
from ..sources import html as H
from .registry import Queries

Q = Queries()


def _tag(kind, head, *args):
    """A term with its arguments: pairs of number:mode and what is within."""
    parts = [F.lit(f'<a data-kg-term="{kind}" data-kg-head="'), head, F.lit('">')]
    for where, inner in args:
        number, mode = where.split(":")
        parts += [F.lit(f'<b data-kg-arg="{number}" data-kg-argmode="{mode}">'), inner, F.lit("</b>é")]
    return F.concat(*parts, F.lit("</a>"))


def pages_of(e):
    """A term for each element: definitions are products of a sum, examples bind a variable of a sum, others are sums of a product."""
    text = lambda s: F.lit(s)
    x = _tag("OMV", F.concat(F.lit("x"), "level"))
    var = lambda name: _tag("OMV", text(name))
    symbol = _tag("OMID", F.concat(F.lit("m?s"), "part"))
    product = _tag("OMA", text("m?times"), ("11:a", _tag("OMA", text("m?plus"), ("1:i", x), ("2:i", symbol))), ("12:a", var("y")))
    binding = _tag("OMBIND", text("m?all"), ("1:b", x), ("2:i", _tag("OMA", text("m?plus"), ("1:i", x), ("2:i", var("z")))))
    sum_ = _tag("OMA", text("m?plus"), ("1:i", _tag("OMA", text("m?f"), ("1:i", x))), ("2:i", _tag("OMA", text("m?times"), ("11:a", var("a")), ("12:a", var("b")))))
    one = F.concat(F.lit('<p data-kg-paragraph="" data-kg-id="e'), "ord", F.lit('">'), F.when(F.col("kind") == "definition", product).when(F.col("kind") == "example", binding).otherwise(sum_), F.lit("</p>"))
    return e.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("h")))), lambda x: x["h"]), "").alias("html"))


def _terms(e):
    return T.terms(H.rows(H.marked(pages_of(e)), dealt=True))


def _written(e):
    rows = [("m?plus", "$1+$2", 20, [20, 20]), ("m?times", "${1*}", 10, [10]), ("m?all", "A$1.$2", 50, [0, T.ANY])]
    notations = e.sparkSession.createDataFrame(rows, "name string, template string, precedence long, argprecs array<long>")
    return T.written(_terms(e), notations).where("parent is null").groupBy("doc", "text").agg(F.count("*").alias("n"))


_TEXT = "CASE kind WHEN 'definition' THEN concat('(x', level, '+s', part, ')*y') WHEN 'example' THEN concat('Ax', level, '.x', level, '+z') ELSE concat('f(x', level, ')+a*b') END"
Q.add("term_texts", "elements", _written, f"SELECT doc, {_TEXT} AS text, count(*) AS n FROM {{elements}} GROUP BY 1, 2")
Q.add("term_symbols", "elements", lambda e: T.symbols(_terms(e)), """WITH s AS (SELECT doc, 'm?plus' AS symbol, CASE kind WHEN 'definition' THEN 1 WHEN 'example' THEN 1 ELSE 0 END AS depth FROM {elements}
UNION ALL SELECT doc, 'm?times', CASE kind WHEN 'definition' THEN 0 ELSE 1 END FROM {elements} WHERE kind <> 'example' UNION ALL SELECT doc, 'm?all', 0 FROM {elements} WHERE kind = 'example'
UNION ALL SELECT doc, 'm?f', 1 FROM {elements} WHERE kind NOT IN ('definition', 'example') UNION ALL SELECT doc, concat('m?s', part), 2 FROM {elements} WHERE kind = 'definition')
SELECT doc, symbol, count(*) AS n, min(depth) AS depth FROM s GROUP BY doc, symbol""")
Q.add("term_free_variables", "elements", lambda e: T.free_variables(_terms(e)).groupBy("doc", "name").agg(F.count("*").alias("n")), """SELECT doc, name, count(*) AS n FROM (SELECT doc, concat('x', level) AS name FROM {elements} WHERE kind <> 'example' UNION ALL SELECT doc, 'y' FROM {elements} WHERE kind = 'definition' UNION ALL SELECT doc, 'z' FROM {elements} WHERE kind = 'example' UNION ALL SELECT doc, n FROM {elements}, (SELECT 'a' AS n UNION ALL SELECT 'b') v WHERE kind NOT IN ('definition', 'example')) x GROUP BY doc, name""")
