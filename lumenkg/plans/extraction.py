"""Annotated HTML, files and triples: pages at hand, and pages made of the derived elements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import trees
from ..sources import html as H
from ..sources import triples as N
from ..sources import turtle
from ..storage import shared_dir
from .registry import Queries

Q = Queries()


def pages_of(e):
    """A page for each document, with an annotated element for each of its elements."""
    attr = F.concat(F.lit(' data-kg-id="e'), "ord", F.lit('" data-kg-fors="sym/'), "part", F.lit('"'))
    one = F.concat(F.lit("<div data-kg-"), "kind", attr, F.lit("><!-- <b> --><span data-kg-title=\"\">é "), "ord", F.lit('</span><br/><a data-kg-term="OMID" data-kg-head="mod/'), "supplier", F.lit('">x &lt; y</a></div>\n'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("h")))), lambda x: x["h"]), "")
    return e.groupBy("k", "doc").agg(F.concat(F.lit("<html><head><style>p < q</style></head><body><section data-kg-section=\"\" data-kg-id=\"s\">"), body, F.lit("</section></body></html>")).alias("html")).drop("k")


def _rows(e):
    return H.rows(H.marked(pages_of(e)), dealt=True)


def _triples(e):
    own = _rows(e)
    return H.triples(own, H.elements(own)).select("g", "s", "p", "o")


Q.add("extract_tags", "pages", lambda p: H.tags(p, "page_id").where("not closing").groupBy("name").agg(F.count("*").alias("n")), "SELECT lower(name) AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '(<(script|style)[^>]*>).*?(</(script|style)>)', '\\1\\3', 'gs'), '<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS name FROM {pages}) x GROUP BY 1")
Q.add("extract_elements", "elements:dealt", lambda e: H.elements(H.page_rows(pages_of(e), kinds=H.CONTAINERS, keys=("fors", "styles"))).select("doc", "kind", "id", "uri", "depth", F.concat_ws(",", "fors").alias("fors")), "SELECT doc, 'section' AS kind, 's' AS id, concat(doc, '&e=s') AS uri, 0 AS depth, '' AS fors FROM {elements} GROUP BY doc UNION ALL SELECT doc, kind, concat('e', ord), concat(doc, '&e=s/e', ord), 1, concat('sym/', part) FROM {elements}")
Q.add("extract_triples", "elements", _triples, "SELECT DISTINCT doc AS g, doc AS s, 'type' AS p, 'document' AS o FROM {elements} UNION SELECT doc, concat(doc, '&e=s'), 'type', 'section' FROM {elements} UNION SELECT doc, doc, 'contains', concat(doc, '&e=s') FROM {elements} UNION SELECT doc, concat(doc, '&e=s'), 'contains', concat(doc, '&e=s/e', ord) FROM {elements} UNION SELECT doc, concat(doc, '&e=s/e', ord), 'type', CASE kind WHEN 'paragraph' THEN 'para' ELSE kind END FROM {elements} UNION SELECT doc, concat(doc, '&e=s/e', ord), CASE kind WHEN 'definition' THEN 'defines' ELSE 'example-for' END, concat('sym/', part) FROM {elements} WHERE kind IN ('definition', 'example', 'paragraph') UNION SELECT doc, concat(doc, '&e=s/e', ord), 'crossrefs', concat('mod/', supplier) FROM {elements}")
Q.add("extract_fragments", "elements:dealt", lambda e: H.elements(H.page_rows(pages_of(e), kinds=H.CONTAINERS, texts=True, keys=())).where("title is not null").select("doc", "id", F.col("title.text").alias("title")), "SELECT doc, concat('e', ord) AS id, concat('é ', ord) AS title FROM {elements}")


def _titles(e):
    """Titles of the pages, every second of which has a title of its own."""
    head = F.when(F.substring_index("doc", "/", -1).cast("long") % 2 == 0, F.concat(F.lit('<body><h1 data-kg-doctitle="">Übung <i>'), "doc", F.lit("</i></h1><h1 data-kg-doctitle=''>second</h1>"))).otherwise("<body>")
    pages = pages_of(e).select("doc", F.replace("html", F.lit("<body>"), head).alias("html"))
    return trees.page_titles(pages)


Q.add("content_titles", "elements:dealt", _titles, "SELECT concat(doc, '&e=s/e', ord) AS uri, concat('é ', ord) AS title FROM {elements} UNION ALL SELECT DISTINCT concat(doc, '&e=s'), '' FROM {elements} UNION ALL SELECT DISTINCT doc, CASE WHEN k % 2 = 0 THEN concat('Übung <i>', doc, '</i>') ELSE '' END FROM {elements}")
Q.add("extract_errors", "elements:dealt", lambda e: H.page_errors(pages_of(e).withColumn("html", F.concat("html", F.lit("<p data-kg-zzz>")))).groupBy("message").agg(F.count("*").alias("n")), "SELECT message, count(DISTINCT doc) AS n FROM {elements}, (SELECT 'unbalanced' AS message UNION ALL SELECT 'unknown key: zzz') m GROUP BY message")


def _kinds(q):
    own = q.select("g", "s", F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), "p", "o", F.when(F.col("p") == "type", "literal").when(F.col("o").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), F.when(F.col("p") == "type", "en").alias("o_lang"), F.lit(None).cast("string").alias("o_dtype"))
    return own.where("s_kind = 'iri' and o_kind != 'bnode'")


def _lines(q):
    return _kinds(q).select("g", N.line(_kinds(q)).alias("value"))


def _turtle(q):
    """Graphs by the last character of their names, written with prefixes and read again."""
    path = f"{shared_dir(q.sparkSession)}/turtle-{uuid.uuid4().hex}"
    turtle.write(_kinds(q.withColumn("g", F.right("g", F.lit(1)))), path, {"doc": "doc/", "sym": "sym/"}, namespace=None)
    return turtle.read(q.sparkSession, path).select("g", "s", "p", "o", "o_kind")


Q.add("triples_round_trip", "quads:", lambda q: N.parsed(_lines(q)).select("g", "s", "p", "o"), "SELECT g, s, p, o FROM {quads} WHERE s NOT LIKE '\\_:%' ESCAPE '\\' AND (o NOT LIKE '\\_:%' ESCAPE '\\' OR p = 'type')")
Q.add("triples_turtle", "quads:", _turtle, "SELECT DISTINCT right(g, 1) AS g, s, p, o, CASE WHEN p = 'type' THEN 'literal' ELSE 'iri' END AS o_kind FROM {quads} WHERE s NOT LIKE '\\_:%' ESCAPE '\\' AND (o NOT LIKE '\\_:%' ESCAPE '\\' OR p = 'type')")


def relation_pages(e):
    """A page for each document, without ids: a module with an import, a use, an extension or a morphism for each element, and declarations; an input and a lost import behind it."""
    supplier, part, ord = (F.col(c).cast("string") for c in ("supplier", "part", "ord"))
    one = (
        F.when(F.col("kind") == "definition", F.concat(F.lit('<i data-kg-import="m'), supplier, F.lit('"></i><b data-kg-symdecl="sym/'), part, F.lit('"></b>')))
        .when(F.col("kind") == "example", F.concat(F.lit('<i data-kg-usemodule="m'), supplier, F.lit('"></i><b data-kg-vardef="var/'), part, F.lit('"></b>')))
        .when(F.col("kind") == "paragraph", F.concat(F.lit('<div data-kg-feature-morphism="mo" data-kg-domain="m'), supplier, F.lit('"><i data-kg-import="n'), ord, F.lit('"></i></div>')))
        .otherwise(F.concat(F.lit('<div data-kg-feature-structure="x/EXTSTRUCT'), ord, F.lit('"><i data-kg-import="a/EXTSTRUCT9"></i>é<i data-kg-import="m'), supplier, F.lit('"></i><i data-kg-import="late"></i><b data-kg-notation="sym/'), part, F.lit('"></b></div>')))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("h")))), lambda x: x["h"]), "")
    return e.groupBy("doc", "k").agg(F.concat(F.lit('<div data-kg-module="m">'), body, F.lit('</div><i data-kg-import="lost"></i><a data-kg-inputref="doc/'), F.col("k") + 1, F.lit('"></a>')).alias("html")).drop("k")


def _relations(e):
    own = H.rows(H.marked(relation_pages(e)), dealt=True)
    found = H.triples(own, H.elements(own), F.lit("arch/a"), F.when(F.col("doc").endswith("7"), "de").otherwise("en"))
    return found.where("p not in ('notation-for') and not (p = 'declares' and o like '%notation%') and not (p = 'type' and o = 'notation')")


_R = """WITH x AS (SELECT *, row_number() OVER (PARTITION BY doc, CASE WHEN kind IN ('problem', 'subproblem') THEN 's' ELSE kind END ORDER BY ord) - 1 AS n FROM {elements}),
y AS (SELECT *, concat(doc, '&e=module') AS m, concat(doc, '&e=module/structure', CASE WHEN n > 0 THEN concat('_', n) ELSE '' END) AS st, concat(doc, '&e=module/morphism', CASE WHEN n > 0 THEN concat('_', n) ELSE '' END) AS mo, kind IN ('problem', 'subproblem') AS is_st FROM x)
"""
Q.add("extract_relations", "elements", _relations, _R + """SELECT doc AS g, doc AS s, 'type' AS p, 'document' AS o FROM y UNION SELECT doc, 'arch/a', 'contains', doc FROM y UNION SELECT doc, doc, 'language', CASE WHEN doc LIKE '%7' THEN 'de' ELSE 'en' END FROM y
UNION SELECT doc, m, 'type', 'theory' FROM y UNION SELECT doc, doc, 'contains', m FROM y UNION SELECT doc, doc, 'hasPart', concat('doc/', k + 1) FROM y
UNION SELECT doc, m, 'imports', concat('m', supplier) FROM y WHERE kind = 'definition' UNION SELECT doc, m, 'declares', concat('sym/', part) FROM y WHERE kind = 'definition' UNION SELECT doc, concat('sym/', part), 'type', 'declaration' FROM y WHERE kind = 'definition'
UNION SELECT doc, doc, 'requires', concat('m', supplier) FROM y WHERE kind = 'example' UNION SELECT doc, m, 'declares', concat('var/', part) FROM y WHERE kind = 'example' UNION SELECT doc, concat('var/', part), 'type', 'variable' FROM y WHERE kind = 'example'
UNION SELECT doc, mo, 'type', 'morphism' FROM y WHERE kind = 'paragraph' UNION SELECT doc, m, 'contains', mo FROM y WHERE kind = 'paragraph' UNION SELECT doc, mo, 'domain', concat('m', supplier) FROM y WHERE kind = 'paragraph' UNION SELECT doc, mo, 'imports', concat('n', ord) FROM y WHERE kind = 'paragraph'
UNION SELECT doc, st, 'type', 'structure' FROM y WHERE is_st UNION SELECT doc, m, 'contains', st FROM y WHERE is_st UNION SELECT doc, st, 'imports', i FROM y, (SELECT 'a/EXTSTRUCT9' AS i UNION ALL SELECT 'late') v WHERE is_st UNION SELECT doc, st, 'imports', concat('m', supplier) FROM y WHERE is_st UNION SELECT doc, st, 'extends', concat('m', supplier) FROM y WHERE is_st""")
